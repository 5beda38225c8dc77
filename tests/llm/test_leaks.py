import random
import re
from collections import defaultdict

from archivolt.llm.leaks import build_index, leaks, search


def plain(docs, items, run):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(len(w) - run + 1):
            grams[tuple(w[a : a + run])].add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for a in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[a : a + run]), ())}
    return out


def test_against_all_windows(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    items = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) + ". " + " ".join(docs[rng.randrange(120)][1].split()[3:9])) for i in range(40)]
    docs += [(500, None), (501, ""), (502, "—"), (503, docs[0][1]), (503, docs[0][1])]
    items += [(600, None), (601, ""), (602, "w1 w2")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, shard string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(d, q, run=4)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == plain(docs, items, 4)
    assert got.count() == len({(r.doc_id, r.item_id) for r in got.collect()})


def test_longest_passage_and_place(spark):
    d = spark.createDataFrame([(1, "zero one two three four five six, SEVEN eight")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "x two three four five six seven y")], "item_id long, text string")
    r = leaks(d, q, run=3).first()
    assert (r.doc_id, r.item_id, r.words, r.place) == (1, 7, 6, 2)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta new gamma delta"), (3, "alpha delta")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    index = build_index(d)
    assert {r.doc_id for r in search(index, q, run=4).collect()} == {1}
    assert {r.doc_id for r in search(index, q, run=4, slop=1).collect()} == {1, 2}
    assert {r.doc_id for r in search(index, q, run=4, least=3).collect()} == {1}


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(d, q).count() == 0
