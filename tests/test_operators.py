"""Core operators against plain Python, on small and awkward inputs."""

import math
import random
import re
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.operators import chunking, entities, evidence, graph, metrics, questions, retrieval
from archivolt.operators.components import connected_components
from archivolt.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_uuid5_is_pythons(spark):
    names = ["Ser Vael", " Lady Ö. ", "x", "漢字"]
    got = {r.n: r.id for r in frame(spark, [(n,) for n in names], "n string").select("n", T.entity_id(F.col("n")).alias("id")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, "ashen_era:entity:" + n.strip().lower())) for n in names}


def count(text):
    return max(1, int(len(text.split()) * 1.3))


def chunked(text, most, overlap):
    out, held, size = [], [], 0
    for p in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
        n = count(p)
        if held and size + n > most:
            out.append("\n\n".join(held))
            back, size = [], 0
            for q in reversed(held):
                if size + count(q) > overlap:
                    break
                back.insert(0, q)
                size += count(q)
            held = back
        held.append(p)
        size += n
    return out + ["\n\n".join(held)] if held else out


def test_chunks_are_those_of_a_plain_loop(spark):
    rng = random.Random(5)
    texts = [(i, "\n\n".join(" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, ""), (101, None), (102, " \n\n ")]
    got = defaultdict(list)
    for r in sorted(chunking.chunks(frame(spark, texts, "doc_id long, text string"), most=40, overlap=12).collect(), key=lambda r: (r.doc_id, r.position)):
        got[r.doc_id].append(r.chunk)
    assert dict(got) == {i: c for i, t in texts if (c := chunked(t or "", 40, 12))}


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 8), (8, 7), (5, 5), (None, 4), (20, 19), (19, 18), (18, 17), (17, 16), (16, 3)]
    got = {r.node: r.component for r in connected_components(frame(spark, links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 16: 1, 17: 1, 18: 1, 19: 1, 20: 1, 7: 7, 8: 7}
    assert connected_components(frame(spark, [], "a long, b long")).count() == 0


def ranked(spark, rows):
    return frame(spark, rows, "qid string, chunk string, rank int")


def test_reciprocal_ranks(spark):
    a, b = ranked(spark, [("q", "c1", 1), ("q", "c2", 2)]), ranked(spark, [("q", "c2", 1), ("q", "c3", 2)])
    got = [(r.chunk, r.streams) for r in retrieval.fused([a, b]).orderBy("rank").collect()]
    assert got == [("c2", 2), ("c1", 1), ("c3", 1)]
    assert retrieval.fused([ranked(spark, [])]).count() == 0


def plain_diversity(docs, most, preserve):
    seen, kept, over = defaultdict(int), [], []
    for i, d in enumerate(docs):
        if i < preserve or seen[d] < most:
            kept.append(i)
            seen[d] += 1
        else:
            over.append(i)
    return kept + over


def test_diversity_is_that_of_a_plain_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for q in range(40):
        docs = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        rows += [(str(q), f"{i}", i + 1, d) for i, d in enumerate(docs)]
        want[str(q)] = [str(i) for i in plain_diversity(docs, 2, 1)]
    got = defaultdict(list)
    for r in retrieval.diversified(frame(spark, rows, "qid string, chunk string, rank int, document string"), "document", 2, 1).orderBy("rank").collect():
        got[r.qid].append(r.chunk)
    assert got == want


def test_interleaving_is_that_of_a_plain_loop(spark):
    rng, one, two, want = random.Random(4), [], [], {}
    for q in range(40):
        x, y = [rng.sample("abcdefghij", rng.randint(0, 8)) for _ in "12"]
        one += [(str(q), c, i + 1) for i, c in enumerate(x)]
        two += [(str(q), c, i + 1) for i, c in enumerate(y)]
        out = []
        for i in range(max(len(x), len(y))):
            for s in (x, y):
                if i < len(s) and s[i] not in out:
                    out.append(s[i])
        if out:
            want[str(q)] = out[:6]
    got = defaultdict(list)
    for r in retrieval.interleaved(ranked(spark, one), ranked(spark, two), 6).orderBy("rank").collect():
        got[r.qid].append(r.chunk)
    assert got == want


def covers(text, terms):
    """The shortest stretches of a text that hold all terms."""
    words, found = text.split(), []
    for s in range(len(words)):
        for e in range(s, len(words)):
            if set(terms) <= set(words[s : e + 1]):
                if not found or found[-1][1] < e:
                    found.append((s, e))
                elif found[-1][1] == e:
                    found[-1] = (s, e)
                break
    return round(sum(1 / (1 + (e - s + 1 - len(terms))) for s, e in found if e - s + 1 >= len(terms)), 6)


def test_cover_density(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["red", "fox", "ran", "xxx", "yyy"]) for _ in range(rng.randint(0, 12)))) for i in range(50)] + [(90, None)]
    got = {r.chunk: r.score for r in retrieval.cover_density(frame(spark, [("q", "red fox ran")], "qid string, question string"), frame(spark, texts, "id long, text string"), "id", "text", 100).collect()}
    want = {i: c for i, t in texts if t and {"red", "fox", "ran"} <= set(t.split()) and (c := covers(t, ["red", "fox", "ran"]))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_bm25_makes_no_row_per_question_and_text(spark):
    rng = random.Random(12)
    words = ["red", "fox", "ran", "Über", "yyy", "zzz"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for i in range(300)] + [(900, None), (901, "?!")]
    asked = [(f"q{i}", " ".join(rng.sample([*words, "none", "of"], rng.randint(1, 4)))) for i in range(40)] + [("r", ""), ("s", None)]
    frame_ = retrieval.bm25(frame(spark, asked, "qid string, question string"), frame(spark, texts, "id long, text string"), "id", "text", 9, block=16)
    assert "Join" not in frame_._jdf.queryExecution().executedPlan().toString()
    said = {i: re.findall(r"\w+", t.lower()) for i, t in texts if t and re.findall(r"\w+", t)}
    mean = sum(map(len, said.values())) / len(said)
    want = set()
    for q, t in asked:
        terms = {w for w in (t or "").lower().split() if w != "of"}
        scores = {}
        for i, w in said.items():
            if terms & set(w):
                parts = ((math.log(1 + (len(said) - n + 0.5) / (n + 0.5)), w.count(x)) for x in terms for n in [sum(x in y for y in said.values())] if x in w)
                scores[i] = round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for idf, tf in parts), 6)
        want |= {(q, i, s, n + 1) for n, (s, i) in enumerate(sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:9])}
    assert {(r.qid, r.chunk, r.score, r.rank) for r in frame_.collect()} == want


def test_cover_density_takes_no_words_out_of_texts(spark):
    rng = random.Random(16)
    words = ["red", "fox", "ran", "xxx", "yyy"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(120)] + [(990, None), (991, "")]
    asked = [(f"q{i}", " ".join(rng.sample(words, rng.randint(1, 3)))) for i in range(20)] + [("r", "none red"), ("s", ""), ("t", None)]
    found = retrieval.cover_density(frame(spark, asked, "qid string, question string"), frame(spark, texts, "id long, text string"), "id", "text", 5, block=8)
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for q, t in asked:
        terms = set((t or "").split())
        scores = [(-covers(x, terms), i) for i, x in texts if x and terms and terms <= set(x.split())]
        want |= {(q, i, n + 1): -s for n, (s, i) in enumerate(sorted(scores)[:5])}
    got = {(r.qid, r.chunk, r.rank): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_terms_that_come_again_and_rows_that_are_shuffled(spark):
    rng = random.Random(18)
    words = ["red", "fox", "ran", "xxx"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    asked = [(f"q{i}", " ".join(rng.sample(words[:3], n))) for i, n in enumerate([1, 1, 2, 2, 3])]
    found = retrieval.cover_density(frame(spark, asked, "qid string, question string"), frame(spark, texts, "id long, text string"), "id", "text", 7)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # a row for each question and task
    got = {(r.qid, r.rank): (r.chunk, r.score) for r in found.collect()}
    want = {}
    for q, t in asked:
        scores = [(-retrieval.covers([[i for i, w in enumerate(x.split()) if w == y] for y in t.split()]), i) for i, x in texts if set(t.split()) <= set(x.split())]
        want |= {(q, n + 1): (i, round(-s, 6)) for n, (s, i) in enumerate(sorted((round(s, 6), i) for s, i in scores)[:7])}
    assert got == want


def test_no_text_of_the_best_is_passed_over():
    rng = np.random.default_rng(4)
    weights = np.vstack([rng.random((9, 40)) * (rng.random((9, 40)) < 0.4), np.zeros(40)])
    unit = 3 / 200
    table = np.ceil(weights / unit).astype(np.uint16)
    terms = np.array([rng.permutation(10)[:3] for _ in range(30)])
    score = weights[terms].sum(axis=1)
    least = rng.random(30)
    r, c = retrieval._passing(table, unit, terms, least, 5)
    kept = set(zip(r.tolist(), c.tolist(), strict=True))
    needed = {(i, j) for i in range(30) for j in np.argsort(-score[i], kind="stable")[:5] if score[i, j] > least[i]}
    assert needed <= kept and len(kept) < (score > 0).sum() / 2
    r, c = retrieval._passing((weights > 0).view(np.uint8), 0, terms, least, 5)
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(i, j) for i in range(30) for j in range(40) if (weights[terms[i], j] > 0).all()]


def test_single_precision_passes_over_none_of_the_best():
    rng = np.random.default_rng(5)
    exact = np.round(rng.random((6, 80)), 2)  # many ties
    state = retrieval.Best(6, 7)
    for at in range(0, 80, 20):
        r, c = state.near((exact[:, at : at + 20] + rng.uniform(-1e-5, 1e-5, (6, 20))).astype(np.float32), 0, 1.1e-5)
        state.add_some(r, exact[r, at + c], at + c, -np.inf)
        state.cut()
    q, score, place = state.cut()
    for i in range(6):
        assert place[q == i].tolist() == sorted(range(80), key=lambda x: (-exact[i, x], x))[:7]
    assert retrieval._order(np.array([1, 0, 1]), np.array([0.5, 1e30, 0.5])).tolist() == [1, 0, 2]


def test_the_best_of_a_stream_are_those_of_all(spark):
    rng = np.random.default_rng(3)
    state, tables = retrieval.Best(5, 4), []
    state.most = 10  # cut often
    for at in range(0, 60, 6):
        tables.append(np.round(rng.random((5, 6)), 1))  # many ties
        state.add(np.arange(5), tables[-1], at)
    q, score, place = state.cut()
    every = np.concatenate(tables, axis=1)
    for i in range(5):
        assert place[q == i].tolist() == sorted(range(60), key=lambda c: (-every[i, c], c))[:4]
        assert score[q == i].tolist() == every[i, place[q == i]].tolist()


def test_questions(spark):
    rows = [
        ("Compare the Ashen Vanguard with House Morvain", "comparison"),
        ("Which war was won by the faction that Ser Vael served?", "multi_hop"),
        ("Was Isolde Mournvale at Greyfell Hall?", "multi_entity"),
        ("who ate it?", "simple"),
        ("", "simple"),
    ]
    df = frame(spark, rows, "q string, k string")
    found = questions.names(F.col("q"))
    for r in df.select("q", "k", found.alias("names"), questions.kind(F.col("q"), found).alias("kind"), questions.sub_questions(F.col("q")).alias("subs"), questions.lexical_query(F.col("q"), found).alias("query")).collect():
        assert r.kind == r.k, r
        assert len(r.subs) == (0 if not r.q else 2 if r.kind == "multi_hop" else 1)
    r = frame(spark, [("Who was the ruler of the stronghold of Marrowwatch?",)], "q string").select(questions.sub_questions(F.col("q")).alias("s")).first()
    assert r.s == ["Where is the stronghold of Marrowwatch?", "Who was the ruler of that stronghold?"] or len(r.s) == 2


def test_gazette_takes_the_longest(spark):
    names = frame(spark, [("Ashen Vanguard",), ("Ashen",), ("Vanguard Hall",), (None,), ("",)], "name string")
    texts = frame(spark, [(1, "The ashen vanguard hall, ASHEN."), (2, None), (3, ""), (4, "none")], "id long, text string")
    got = {(r.id, r.name, r.n) for r in entities.gazette_matches(texts, names, "id", "text").collect()}
    assert got == {(1, "Ashen Vanguard", 1), (1, "Ashen", 1)}


def test_gazette_writes_out_only_runs_that_may_be_names(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(30)] + ["Çava", "漢字"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    found = entities.gazette_matches(frame(spark, texts, "id long, text string"), frame(spark, [(n,) for n in names], "name string"), "id", "text", 3)
    assert "explode(flatten(" not in found._jdf.queryExecution().executedPlan().toString()
    want, known = set(), {tuple(n.lower().split()): n for n in names if len(n.split()) <= 3}
    for i, t in texts:
        w = t.lower().split()
        spans, kept = sorted((-g, a, known[tuple(w[a : a + g])]) for a in range(len(w)) for g in (1, 2, 3) if a + g <= len(w) and tuple(w[a : a + g]) in known), []
        for g, a, n in spans:
            if all(a - g <= b or b - h <= a for h, b, _ in kept):
                kept.append((g, a, n))
        said = [n for _, _, n in kept]
        want |= {(i, n, said.count(n)) for n in said}
    assert {(r.id, r.name, r.n) for r in found.collect()} == want


def test_lookup_prefers_names(spark):
    known = frame(spark, [(1, "Vael", ["Ser Vael"], 5), (2, "Ser Vael", [], 1), (3, "Lord", None, None)], "entity_id long, name string, aliases array<string>, mention_count int")
    got = {r.asked: (r.entity_id, r.exact) for r in entities.looked_up(frame(spark, [("ser vael",), ("VAEL",), (None,), ("nobody",)], "name string"), known).collect()}
    assert got == {"ser vael": (2, True), "VAEL": (1, True)}


def test_trails_use_edges_once(spark):
    edges = frame(spark, [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a")], "edge string, src string, dst string")
    got = {r.path for r in graph.trails(edges, frame(spark, [("a",)], "node string"), 3).collect()}
    assert got == {"a > b", "a > c", "a > b > c", "a > c > b"}


def test_infobox(spark):
    page = "# Ser Vael\n| **Allegiance** | [[Ashen Vanguard|the Vanguard]] (faction) |\n| Members | A, B; none |\n| Colour | red |"
    got = {(r.source, r.relation, r.target) for r in graph.infobox_relations(frame(spark, [("Ser Vael", page), ("x", None)], "t string, x string"), "t", "x").collect()}
    assert got == {("Ser Vael", "MEMBER_OF", "Ashen Vanguard"), ("A", "MEMBER_OF", "Ser Vael"), ("B", "MEMBER_OF", "Ser Vael")}


def test_conflict_counts(spark):
    schema = "qid string, record_id long, content string, source_characteristics struct<claim_strength:string>"
    rng = random.Random(8)
    texts = ["he was accused", "he was loyal", "accused yet loyal", "he won", "it failed", "nothing", None]
    rows = [(str(q), q * 100 + i, rng.choice(texts), Row(claim_strength="assertion")) for q in range(8) for i in range(rng.randint(0, 9))]
    got = {(r.qid, r.tenor): r.pairs for r in evidence.conflicts(frame(spark, rows, schema)).collect()}
    want = defaultdict(int)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            for k, (n, p) in enumerate(evidence.OPPOSED):
                x, y = ((r[2] or "") + " assertion" for r in (a, b))
                on = lambda t, ws: any(w in t for w in ws)
                if a[0] == b[0] and (on(x, n) and on(y, p) or on(x, p) and on(y, n)):
                    want[a[0], k] += 1
    assert got == dict(want)


def test_sources_and_places(spark):
    rows = [("ephemera/trial_transcript_1.scan.pdf", "ephemera", "allegation"), ("wiki/a.md", "wiki", "assertion"), ("x/letter_concerning_b.txt", None, "personal"), ("", None, "assertion")]
    for r in frame(spark, rows, "f string, c string, want string").select("want", evidence.traits(F.col("f"), F.col("c")).alias("t")).collect():
        assert r.t.claim_strength == r.want
    rows = [(84, "{}", "p.84"), (None, None, "p.1"), (7, '{"line_start":3,"line_end":9}', "p.7 (Lines 3-9)"), (None, '{"line_start":"Plate"}', "Plate"), (2, '{"reference_location":"Section 4"}', "Section 4")]
    for r in frame(spark, rows, "p int, m string, want string").select("want", evidence.place_of(F.col("p"), F.col("m")).alias("at")).collect():
        assert r.at == r.want


def test_citations(spark):
    records = frame(spark, [("q", "EVIDENCE_001", 1, "Royal Annals", "text", 84, None), ("q", "EVIDENCE_002", 2, None, " ", None, None)], "qid string, id string, record_id long, document_title string, content string, page int, metadata string")
    answers = frame(spark, [(1, "q", "Vael [EVIDENCE_1] and [EVIDENCE_002]; EVIDENCE_999"), (2, "q", None), (3, "z", "none")], "result_id long, qid string, answer string")
    got = {r.result_id: r.answer for r in evidence.resolved(answers, records).collect()}
    assert got == {1: "Vael [Royal Annals, p.84] and [Archive Document, p.1]; EVIDENCE_999", 3: "none"}
    assert {(r.number, r.issue) for r in evidence.citation_issues(answers, records).collect()} == {(2, "unsupported"), (999, "missing")}


def test_claims(spark):
    rows = [(1, "Ser Vael was accused of treason, in 312 AS."), (2, "Mara founded the Hall. Oren belonged to the Watch."), (3, None), (4, "")]
    got = {(r.record_id, r.predicate, r.object) for r in evidence.claims(frame(spark, [(i, t, None) for i, t in rows], "record_id long, content string, source_characteristics struct<claim_strength:string>")).collect()}
    assert got == {(1, "accused_of", "treason"), (2, "founded", "Hall"), (2, "member_of", "Watch")}


def test_joint_recall(spark):
    targets = frame(spark, [("q", 1, "alpha"), ("q", 2, "beta")], "qid string, hop int, target string")
    items = lambda docs: frame(spark, [("q", i + 1, d, t) for i, (d, t) in enumerate(docs)], "qid string, rank int, document string, text string")
    score = lambda docs, k: metrics.joint_recall(items(docs), targets, k).first().joint
    assert score([("A", "Alpha"), ("B", "beta")], 1) == 0
    assert score([("A", "Alpha"), ("B", "beta")], 2) == 1
    assert score([("A", "alpha beta")], 5) == 0


@pytest.mark.parametrize("text, value", [("87.349", 87349.0), ("3.5", 3.5), ("1,200", 1200.0), ("x", None)])
def test_plate_numbers(spark, text, value):
    assert frame(spark, [(text,)], "t string").select(files.plate_number(F.col("t")).alias("n")).first().n == value


def test_picture_kinds(spark):
    rows = [("plate_03_b_iron_gate.png", "figure_plate", "iron gate"), ("atmo_dark_hall_character_ser_vael.png", "character", "ser vael"), ("map.jpg", "illustration", "map")]
    for r in frame(spark, rows, "f string, k string, s string").select("*", files.picture_kind(F.col("f")).alias("p")).collect():
        assert (r.p.kind, r.p.subject) == (r.k, r.s)


def test_markdown_sections(spark):
    rows = [(1, "intro\n# One\na\nb\n## Two\n\n### Three\nc"), (2, None), (3, "")]
    got = {(r.id, r.section_no, r.title, r.level, r.content) for r in files.markdown_sections(frame(spark, rows, "id long, t string"), "id", "t").collect()}
    assert got == {(1, 0, None, 0, "intro"), (1, 1, "One", 1, "a\nb"), (1, 3, "Three", 3, "c")}


def test_plates(spark):
    text = "Iron Gate\nRecorded Garrison Strength\n87.349\nsouls under arms\nTolerance\n3.5\nAs entered into the Codex\n12"
    df = frame(spark, [(1, text), (2, None), (3, "no figures")], "id long, t string")
    got = {(r.id, r.label, r.value, r.is_primary) for r in files.plate_figures(df, "id", "t").collect()}
    assert got == {(1, "Recorded Garrison Strength", 12.0, True), (1, "Tolerance", 3.5, False)} or got == {(1, "Recorded Garrison Strength", 12.0, True), (1, "Tolerance", 3.5, False), (1, "Value", 12.0, False)}
    notes = {r.id: (r.unit, r.provenance) for r in files.plate_notes(df, "id", "t").collect()}
    assert notes[1] == ("souls under arms", "As entered into the Codex") and notes[3] == (None, None)


def test_judgement(spark):
    records = frame(spark, [("q", 1, "EVIDENCE_001", "Vael was accused of treason", None, "A", 1, None), ("q", 2, "EVIDENCE_002", "Vael was loyal", None, "B", 1, None), ("z", 3, "EVIDENCE_001", "Mara built the hall", None, "C", 1, None)], "qid string, record_id long, id string, content string, source_characteristics struct<claim_strength:string>, document_title string, page int, metadata string")
    answers = frame(spark, [(1, "q", "Vael was accused of treason [EVIDENCE_001]"), (2, "q", "Vael was loyal to the last [EVIDENCE_002]"), (3, "z", "Mara built the hall [EVIDENCE_009]"), (4, "z", "There is insufficient information to answer."), (5, "z", None), (6, "z", "Mara built the hall [EVIDENCE_001]")], "result_id long, qid string, answer string")
    got = {r.result_id: r.is_verified for r in evidence.judged(answers, records).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}
    assert {(r.result_id, r.record_id) for r in evidence.citation_details(answers, records).collect()} == {(1, 1), (2, 2), (6, 3)}


def test_support(spark):
    rows = [(1, "In 912 it fell.", [("in 912",)]), (2, "In 912 it fell.", [("in 900",)]), (3, "It fell.", [("x",)]), (4, "It fell.", []), (5, None, [("x",)]), (6, "1,200 men", [("1200 men",)]), (7, "x", None)]
    got = {r.result_id: r.supported for r in metrics.support(frame(spark, rows, "result_id long, answer string, citations array<struct<excerpt:string>>")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}


def test_assets(spark):
    assets = frame(spark, [(1, '"Iron Gate"'), (2, "Hall"), (3, "Key"), (4, None)], "asset_id long, entity_name string")
    asked = frame(spark, [("q", "Who built the iron gate and the hall?"), ("z", "What of keys?")], "qid string, question string")
    assert {(r.qid, r.asset_id) for r in metrics.assets_for(asked, assets).collect()} == {("q", 1), ("q", 2)}


def test_relations_are_checked(spark):
    good = frame(spark, [("a", "MEMBER_OF", "b")], "src string, relation string, dst string")
    assert graph.checked(good).count() == 1
    with pytest.raises(Exception, match="not a relation"):
        graph.checked(frame(spark, [("a", "member of", "b")], "src string, relation string, dst string")).collect()


def test_lists_of_tasks_are_fused_as_ranked_lists_are(spark):
    """Of what three tasks found for a stream the first few by score, then chunk; the same rows as of merged and ranked lists."""
    rng = random.Random(5)
    streams = []
    for depth in (4, 3):
        tasks = [[("ab"[q], sorted((-rng.randint(1, 3), c) for c in rng.sample(range(t, 30, 3), rng.randint(1, 6)))) for q in range(2)] for t in range(3)]
        streams.append(([spark.createDataFrame([(q, [x for x, _ in rows], [c for _, c in rows]) for q, rows in task], "qid string, less array<long>, chunk array<long>") for task in tasks], depth))
    got = retrieval.fused_lists(streams, most=5).collect()
    want = retrieval.fused([retrieval._merged(found, depth) for found, depth in streams], most=5).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) and len(got) == 10


def test_words_of_plain_and_other_texts(spark):
    """Words as ``tokens`` has them, whether split in batches or by Spark."""
    from archivolt.functions.text import plain_or_tokens, tokens, words_of

    texts = ["The Iron-Key_7 of X9", "", "...", "end", "start", "\u00c4ra D\u00c9J\u00c0 vu", "no", "  two  words\n", "\u4e2d\u6587 42", "\u2014"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    want = {r.id: r.w for r in rows.select("id", tokens(F.col("text")).alias("w")).collect()}
    got = {}
    for x in rows.select("id", *plain_or_tokens(F.col("text"))).toArrow().to_batches():
        for row, length, words in words_of(x):
            ends = length.cumsum()
            got |= {x.column("id")[int(i)].as_py(): words.to_pylist()[e - n : e] for i, n, e in zip(row, length, ends, strict=True)}
    assert got == want
