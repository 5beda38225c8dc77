"""Gazette, entities of texts and aliases against plain Python, on small and awkward inputs."""

import random
import re

from pyspark.sql import functions as F

from archivolt.operators import chunking, evidence, graph, naming
from archivolt.sources import files


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, name, n):
    for _ in range(n):
        i = rng.randrange(len(name))
        name = rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("abcxyz") + name[i:], name[:i] + rng.choice("abcxyz") + name[i + 1 :]])
    return name


def test_near_names_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde") for _ in range(n)) for n in (4, 5, 6, 9, 14, 30, 47, 48, 49, 50, 51, 52, 53, 90)]
    names = sorted({x for b in base for x in [b, *(changed(rng, b, rng.randint(1, 4)) for _ in range(8))]} | {"", "abcd"})
    got = {(r.a, r.b) for r in naming.near_names(spark.createDataFrame([(n,) for n in [*names, None, names[3]]], "core string")).collect()}
    long = [n for n in names if len(n) >= 5]
    assert got == {(a, b) for a in long for b in long if a < b and distance(a, b) <= 2}


def core(name):
    name = re.sub(r"(?i)^(ser|lord|lady|high|the)\s+", "", name.strip())
    name = re.sub(r"(?i)\s+the\s+\S+$", "", name)
    return re.sub(r"(?i)\s+of\s+(the\s+)?\S+(\s+\S+)?$", "", name).strip().lower()


def one_by_one(rows, known):
    heads = sorted({k.strip() for k in known if k and k.strip()}, key=lambda k: (k.lower().startswith("the "), len(k), k))
    best = {}
    for n, s in rows:
        if n and n.strip():
            best[n.strip()] = max(best.get(n.strip(), 0), {"gazette": 3, "gemini_ner": 2, "rules": 1}.get(s, 0))
    found = {}
    for n in sorted(best, key=lambda n: (-best[n], len(n), n)):
        for h in heads:
            a, b = core(n), core(h)
            if n.lower() == h.lower() or (a and a == b) or (len(a) > 4 and len(b) > 4 and distance(a, b) <= 2):
                found[n] = h
                break
        else:
            heads.append(n)
            found[n] = n
    return found


def test_aliases_are_those_of_an_ordered_fold(spark):
    rng = random.Random(3)
    base = ["Mara Oren", "Ser Mara Oren", "Vael", "Toben Harl", "Lady Toben Harl of Brek", "The Guild", "Guild", "Oskar Pell the Bold"]
    rows = [(changed(rng, rng.choice(base), rng.randint(0, 3)), rng.choice(["rules", "gazette", "gemini_ner", None, "other"])) for _ in range(120)]
    rows += [(None, "rules"), ("  ", "rules"), (" Vael ", "rules"), ("VAEL", "rules")]
    df = spark.createDataFrame(rows, "name string, source string")
    for known in ([], ["Mara Oren", "Mara Orel", "the Vael", None]):
        table = spark.createDataFrame([(k,) for k in known], "name string") if known else None
        got = {r.name: r.canonical for r in naming.resolved(df, table).collect()}
        assert got == one_by_one(rows, known)
    assert naming.resolved(df.limit(0)).count() == 0


def test_a_chain_of_near_names_is_settled_in_one_task(spark, monkeypatch):
    """Names each near the one before took a round each, with jobs and plans of their own: what fits one task has none; in rounds the rows are the same."""
    rows = [("abcdefgh" + "xyz"[i % 3] * (2 * i + 1), "rules") for i in range(8)]
    df = spark.createDataFrame(rows, "name string, source string")
    cuts, cut = [], naming.cut
    monkeypatch.setattr(naming, "cut", lambda x: cuts.append(x) or cut(x))
    together = {r.name: r.canonical for r in naming.resolved(df).collect()}
    assert len(cuts) == 3 and len(together) == 8
    monkeypatch.setattr(naming, "AT_ONCE", 0)
    assert {r.name: r.canonical for r in naming.resolved(df).collect()} == together


def test_gazette_of_files(spark):
    box = "# The Hall (location)\n| Elevation | 9 |\n| Role | x |"
    rows = [
        ("images/atmo_portrait_character_mara_oren.png", None),
        ("images/plate_12_faction_the_grey_hand.png", None),
        ("images/plate_13_odd_thing.png", None),
        ("wiki/mara_oren.md", "![Mara Oren](x.png)\n| Diet | fish |"),
        ("wiki/hall.md", box),
        ("wiki/wiki_creature_wyrm.md", None),
        ("wiki/plain.md", "no heading"),
        ("wiki/a.txt", "# Not read"),
        ("codex/hall.pdf", ""),
        (None, "# Nothing"),
    ]
    got = {r.name: r.entity_type for r in naming.gazette(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"Mara Oren": "PERSON", "The Grey Hand": "FACTION", "Grey Hand": "FACTION", "Thing": "UNKNOWN", "The Hall": "PLACE", "Hall": "DOCUMENT", "Wyrm": "CREATURE", "Plain": "UNKNOWN"}


def test_entities_of_texts(spark):
    texts = spark.createDataFrame([(1, "Mara met MARA OREN and the Hand; 12 times."), (2, ""), (3, None), (4, "nobody")], "k long, t string")
    forms = spark.createDataFrame([("Mara", "Mara Oren", "PERSON"), ("Mara Oren", "Mara Oren", "PERSON"), ("Hand", "Grey Hand", None), ("12", "Twelve", "X"), ("x", "X", "X"), (None, "N", "X"), ("nobody", None, "X")], "form string, name string, entity_type string")
    got = {(r.k, r.name, r.entity_type, r.mentions, r.n) for r in naming.entities_of(texts, forms, "k", "t").collect()}
    assert got == {(1, "Mara Oren", "PERSON", "Mara|Mara Oren", 2), (1, "Grey Hand", None, "Hand", 1)}


def test_chunks_by_category(spark):
    long = "\n\n".join(f"{'w ' * 300}{i}" for i in range(3))
    rows = [
        (1, "T", "Wiki", f"before\n# One\nfirst\nsecond\n## Empty\n\n## Long\n{long}"),
        (2, "T", "codex", "# One\n\n| a | b |\n| 1 |2|\n\nprose"),
        (3, None, "ephemera", " one\n\ntwo "),
        (4, "T", None, None),
        (5, "T", "wiki", " \n "),
        (6, "T", "chronicles", f"# C\n{long}"),
    ]
    got = {}
    for r in chunking.chunks_by_category(spark.createDataFrame(rows, "doc_id long, title string, source_category string, text string")).collect():
        got[r.doc_id, r.position] = r
    assert {k[0] for k in got} == {1, 2, 3, 6}
    assert [(got[1, i].section_title, got[1, i].chunk) for i in range(2)] == [(None, "before"), ("One", "first\nsecond")]
    assert (got[1, 2].section_title, got[1, 2].page, got[1, 2].line_start, got[1, 1].line_end) == ("Long", 2, 51, 28) and (1, 4) in got and (1, 5) not in got
    assert (got[2, 0].chunk, got[2, 0].section_title, got[2, 0].line_start) == ("Table: T\na | b\n1 | 2", "Data Table", None) and got[2, 1].section_title == "One"
    assert (got[3, 0].chunk, got[3, 0].section_title, (3, 1) in got) == ("one\n\ntwo", None, False)
    assert [got[6, i].section_title for i in range(3)] == ["C"] * 3


def test_picture_chunk_and_its_document(spark):
    rows = spark.createDataFrame([("Mara", "figure_plate", "A plate.", {"Losses": 3.0}), (None, "portrait", None, None)], "n string, k string, d string, f map<string,double>")
    got = [r.t for r in rows.select(chunking.picture_chunk(F.col("n"), F.col("k"), F.col("d"), F.col("f")).alias("t")).collect()]
    assert got == ["Visual Archive Record: Mara\nAsset Type: Figure Plate\nDescription: A plate.\nRecorded Data: Losses: 3.0", "Visual Archive Record: Artwork\nAsset Type: Portrait"]
    pictures = spark.createDataFrame([("i/atmo_portrait_character_mara.png",), ("i/plate_12_hall.png",), ("i/plate_12_x.png",), ("i/y.png",), (None,)], "path string")
    known = spark.createDataFrame([("mara", "2"), ("mara", "1"), ("hall", "3"), (None, "4")], "stem string, id string")
    assert {(r.path, r.id) for r in files.attached(pictures, known).collect()} == {("i/atmo_portrait_character_mara.png", "1"), ("i/plate_12_hall.png", "3"), ("i/plate_12_x.png", None), ("i/y.png", None)}


def test_stored_relations(spark):
    rows = [("A", "B", "knows", 0.5, 1), ("a2", "B", "KNOWS", 0.9, 2), ("A", "C", "KNOWS", 1.0, 3), ("A", "B", "no good!", 1.0, 4), (None, "B", "KNOWS", 1.0, 5), ("A", "", "KNOWS", 1.0, 6), ("B", "A", "KNOWS", None, 7), ("B", "A", "KNOWS", 0.1, 7), ("A", "B", None, 1.0, 8)]
    relations = spark.createDataFrame(rows, "source string, target string, relation string, confidence double, seq long")
    found = spark.createDataFrame([("A", "1"), ("a2", "1"), ("B", "2"), ("C", "9")], "asked string, id string")
    got = {tuple(r) for r in graph.stored(relations, found, spark.createDataFrame([("1",), ("2",), ("2",)], "id string")).collect()}
    assert got == {("1", "2", "KNOWS", 0.9, 2), ("2", "1", "KNOWS", 0.1, 7)}


def test_state_sufficiency(spark):
    states = spark.createDataFrame([("a", "multi_hop", ["Mara", "Vael"], 2), ("b", "multi_hop", ["Mara", "Vael"], 1), ("c", "simple", ["Mara", "Zorn"], 1), ("d", "simple", [], 1), ("e", "multi_hop", ["Zorn"], 2), ("f", "simple", ["Mara"], 1)], "qid string, kind string, names array<string>, hops int")
    items = [(q, i, f"d{i}", None, "Mara met Vael") for q in "abcde" for i in (1, 2)] + [("a", 11, None, "T", "late")]
    got = {r.qid: (r.level, r.coverage, r.missing, r.records) for r in evidence.state_sufficiency(states, spark.createDataFrame(items, "qid string, rank int, document_id string, document_title string, content string")).collect()}
    assert got == {"a": ("HIGH", 0.95, 0, 3), "b": ("MEDIUM", 0.65, 0, 2), "c": ("MEDIUM", 0.6, 1, 2), "d": ("HIGH", 1.0, 0, 2), "e": ("INSUFFICIENT", 0.1, 1, 2), "f": ("INSUFFICIENT", 0.0, 1, 0)}
