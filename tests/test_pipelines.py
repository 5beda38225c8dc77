"""Providers, files, answers and the stream of deliveries."""

import datetime as dt
import io
import re
import zipfile
from hashlib import md5

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivolt.functions import providers
from archivolt.operators import retrieval
from archivolt.plans import answering
from archivolt.sources import documents
from archivolt.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return data.getvalue()


def p(text, style=None):
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f"<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(p("intro") + p("One", "Heading2") + p("text") + "<w:tbl><w:tr><w:tc>" + p("x") + "</w:tc><w:tc>" + p("y") + "</w:tc></w:tr></w:tbl>"))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    rows = documents.docx_sections(documents.archive(spark, str(tmp_path), "*.docx")).collect()
    assert {(r.section_no, r.title, r.level, r.content) for r in rows if r.path.endswith("a.docx")} == {(0, "Introduction", 1, "intro"), (1, "One", 2, "text\nx | y")}
    assert [r.error for r in rows if r.path.endswith("b.docx")] == ["BadZipFile"]


def test_first_good(spark):
    rows = spark.createDataFrame([(None, "short", "x" * 30), (None, None, None)], "a string, b string, c string")
    assert [r.t for r in rows.select(documents.first_good(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == ["x" * 30, "[no text]"]


def test_vectors_are_deterministic(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string").select(providers.embedded(F.col("t"), 8).alias("v")).collect()
    assert rows[0].v == rows[1].v and any(rows[0].v) and not any(rows[2].v) and not any(rows[3].v)


def test_vectors_of_texts_and_with_titles_in_one_pass():
    texts = ["The red fox, the red_fox ran", None, "", "Straße ÇAVA 12", "漢字 a" * 3, "fox " * 200]
    before = ["A red", "only", "", "İ", "", "the fox"]
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def vector(words):
        v = [0.0] * 8
        for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = int.from_bytes(md5(g.encode()).digest()[:4])
            v[h % 8] += 1.0 if h >> 31 else -1.0
        return v

    own, both = providers.hashed_vectors(texts, 8, before)
    assert own.tolist() == [vector(plain(t)) for t in texts] == providers.hashed_vectors(texts, 8)[0].tolist()
    assert both.tolist() == [vector(plain(b) + plain(t)) for b, t in zip(before, texts, strict=True)]
    stored = retrieval.small(own)
    assert stored[1] is None and len(stored[0]) == 8 and len(stored[5]) == 32  # a byte a number, if it fits
    assert retrieval._wide(pa.array([v for v in stored if v]), 8).tolist() == own[own.any(axis=1)].tolist()


def test_cache(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id long, t string")
    cache = spark.createDataFrame([("a", "old")], "t string, value string").select(F.sha2("t", 256).alias("hash"), "value")
    asked = []

    def provider(missing):
        asked.append(sorted(r.text for r in missing.collect()))
        return missing.select("hash", F.concat(F.lit("new "), "text").alias("value"))

    got = {r.id: r.value for r in providers.cached(rows, cache, "t", provider).collect()}
    assert got == {1: "old", 2: "new b", 3: "new b", 4: None} and asked == [["b"]]


@pytest.fixture
def tables(spark):
    records = spark.createDataFrame(
        [(1, "z", "c1", "d1", "Annals", "Ser Vael founded the Hall. It rained.", 0.5), (2, "z", "c2", "d2", "Roll", "Mara Oren met Ser Vael in the Hall.", 0.4), (3, "z", "c3", "d3", "Deed", "Mara Oren kept the iron key.", 0.3), (4, "z", "c4", None, None, None, None)],
        "record_id long, qid string, chunk_id string, document_id string, document_title string, content string, score double",
    )
    names = spark.createDataFrame([("Ser Vael",), ("Mara Oren",)], "name string")
    return records, names


def test_answers_cite_or_decline(spark, tables):
    asked = spark.createDataFrame([("a", "Which Hall was founded by Ser Vael?"), ("b", "Where is Zorn Quux?")], "qid string, question string")
    got = {r.qid: r for r in answering.answers(asked, *tables).collect()}
    assert "founded the Hall" in got["a"].answer and "[EVIDENCE_001]" in got["a"].answer and got["a"].level in ("HIGH", "MEDIUM")
    assert got["b"].answer.startswith("The archive does not hold")


def test_dense_stream_and_depth(spark, tables):
    asked = spark.createDataFrame([("a", "Zorn Quux?"), ("b", "iron")], "qid string, question string")
    records = spark.createDataFrame([(i, f"d{i}", None, "iron " + "x " * i) for i in range(60)], "record_id long, document_id string, document_title string, content string")
    # no word and no name of the first stands in a record: only vectors find any
    got = answering.retrieved(asked, records, tables[1]).groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in got} == {"a": 20, "b": 20}


def test_second_hop_goes_over_a_name(spark, tables):
    asked = spark.createDataFrame([("a", "Where is the key of whom Ser Vael met?")], "qid string, question string")
    edges = answering.together(answering.mentioned(*tables))
    found = answering.discovered(spark.createDataFrame([("a", "Ser Vael")], "qid string, name string"), edges)
    assert [(r.name, r.chunk, r.hops) for r in found.collect()] == [("Mara Oren", 2, 1)]
    assert "Mara Oren" in answering.bridged(asked, found).first().question
    assert 3 in {r.chunk for r in answering.multi_hop(asked, *tables).collect()}


def test_second_hop_asks_the_other_sub_questions_and_spreads_documents(spark, tables):
    asked = spark.createDataFrame([("a", "Who founded the hall that holds the iron key today?")], "qid string, question string")
    rows = [(i, "d" if i < 10 else f"d{i}", None, "iron key holds today" if i < 10 else "hall founded") for i in range(20)]
    records = spark.createDataFrame(rows, "record_id long, document_id string, document_title string, content string")
    c = answering.Config(per_document=1, preserve=30, k=5)
    found = spark.createDataFrame([], "qid string, name string, hops int")
    assert answering.bridged(asked, found).first().question == "Who founded the hall that entity?"
    got = {r.rank: r.chunk for r in answering.multi_hop(asked, records, tables[1], c).collect()}
    # the first hop finds records of one document only, of which one stays
    assert set(got) == {1, 2, 3, 4, 5} and [n for n, chunk in got.items() if chunk < 10] == [1]


def test_trails_keep_the_nearest_names(spark):
    said = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (2, "C"), (3, "C"), (3, "D"), (4, "A"), (4, "B"), (5, "E"), (6, None)], "chunk long, name string")
    edges = answering.together(said)
    asked = spark.createDataFrame([("q", "A"), ("q", "A"), ("r", "E"), ("s", "nobody")], "qid string, name string")
    got = lambda c: sorted((r.qid, r.name, r.chunk, r.hops) for r in answering.discovered(asked, edges, c).collect())
    assert got(answering.Config()) == [("q", "B", 1, 1), ("q", "C", 2, 2)]
    assert got(answering.Config(hops=3)) == [("q", "B", 1, 1), ("q", "C", 2, 2), ("q", "D", 3, 3)]
    assert got(answering.Config(hops=3, paths=2)) == [("q", "B", 1, 1), ("q", "C", 2, 2)]


def test_both_hops_are_retrieved_at_once(spark, tables, monkeypatch):
    """The second hop doesn't depend on what the first finds: texts are read, numbered and looked through once for both."""
    asked = spark.createDataFrame([("a", "Where is the key of whom Ser Vael met?"), ("b", "iron")], "qid string, question string")
    calls, retrieved = [], answering.retrieved
    monkeypatch.setattr(answering, "retrieved", lambda questions, *rest: calls.append(questions.count()) or retrieved(questions, *rest))
    got = answering.multi_hop(asked, *tables).collect()
    assert calls == [3] and {r.qid for r in got} == {"a", "b"}


def test_trails_of_a_name_with_many_neighbours(spark, monkeypatch):
    """Of a hub's neighbours only those that can be kept are joined, and the names found are the first ones nevertheless."""
    name = lambda i: f"n{i:03d}"
    said = [(i, n) for i in range(1, 200) for n in ("hub", name(i))] + [(1000, "edge"), (1000, "hub"), (1001, name(1)), (1001, "edge")]
    stored, cut = [], answering.cut
    monkeypatch.setattr(answering, "cut", lambda df: stored.append(out := cut(df)) or out)
    asked = spark.createDataFrame([("q", "hub"), ("q", name(2)), ("r", "edge"), ("s", name(7))], "qid string, name string")
    got = answering.discovered(asked, answering.together(spark.createDataFrame(said, "chunk long, name string")), answering.Config(paths=5)).collect()
    assert stored[0].filter("a = 'hub'").count() == 7
    found = {q: [(r.name, r.hops, r.chunk) for r in sorted(got, key=lambda r: (r.hops, r.name)) if r.qid == q] for q in "qrs"}
    assert found["q"] == [("edge", 1, 1000), (name(1), 1, 1), (name(3), 1, 3), (name(4), 1, 4), (name(5), 1, 5)]
    assert found["r"] == [("hub", 1, 1000), (name(1), 1, 1001), (name(2), 2, 2), (name(3), 2, 3), (name(4), 2, 4)]
    assert found["s"] == [("hub", 1, 7), ("edge", 2, 1000), (name(1), 2, 1), (name(2), 2, 2), (name(3), 2, 3)]


def test_streamed_deliveries(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    rows = [(1, "codex", day), (1, "codex", day + dt.timedelta(hours=2)), (2, "wiki", day + dt.timedelta(hours=1)), (None, "wiki", day), (3, "wiki", None)]
    df = spark.createDataFrame(rows, "record_id long, source_category string, registered_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.first_deliveries(ingest.arriving(spark, str(tmp_path / "in"), df.schema))
    ingest.written(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_answers_store_what_is_read_several_times(spark, data, monkeypatch):
    """The records that all streams read, and what was retrieved, which three later steps read."""
    from archivolt.plans import queries

    stored, cut = [], answering.cut
    monkeypatch.setattr(answering, "cut", lambda df: stored.append(df.columns) or cut(df))
    queries.QUERIES["x18_answers"](spark, data)
    assert stored[0] == ["record_id", "content", "document_id", "document_title", "section_title", "source_category"] and stored[-1] == ["qid", "record_id", "seq"]


def test_interleaved_streams_share_their_records(spark, data, monkeypatch):
    from archivolt.plans import queries

    read, once = [], queries.evidence.once
    monkeypatch.setattr(queries.evidence, "once", lambda rows: read.append(1) or once(rows))
    queries.QUERIES["v10_interleaved"](spark, data)
    assert len(read) == 1
