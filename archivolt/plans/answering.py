"""From questions to cited answers, and multi-hop retrieval, as one lazy plan over a batch of questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.providers import composed, embedded, hashed_vectors
from archivolt.operators import evidence, retrieval
from archivolt.operators.entities import Gazette, gazette, gazette_matches
from archivolt.operators.questions import sub_questions
from archivolt.plans.session import cut


#: Words of the longest names that are looked up.
MOST_WORDS = 6
#: Numbers of a text's vector.
SIZE = 64


@dataclass(frozen=True)
class Config:
    """What can be set; the defaults are those of the behaviour that is reproduced."""

    bm25_k: int = 50
    dense_k: int = 50
    contextual_k: int = 50
    entity_k: int = 50
    rrf_k: int = 60
    rrf_most: int = 100
    per_document: int = 3
    preserve: int = 3
    pool: int = 30
    k: int = 20
    context_tokens: float = 3500.0
    bridges: int = 5
    hops: int = 2
    paths: int = 20
    lexical: bool = True
    dense: bool = True
    contextual: bool = True
    entities: bool = True
    category: str | None = None


def mentioned(records: DataFrame, names: DataFrame | Gazette) -> DataFrame:
    """(chunk, name): which names each record holds: computed once for all hops."""
    return cut(gazette_matches(records.filter("content is not null"), names, "record_id", "content", MOST_WORDS).select(F.col("record_id").alias("chunk"), "name"))


def vectors(records: DataFrame, contextual: bool = False) -> DataFrame:
    """(id, vector) of the records whose text has one, of the text itself or with its document's and section's title before it (those that the records have)."""
    before = [x for x in ("document_title", "section_title") if contextual and x in records.columns]
    text = F.concat_ws(" ", *before, "content")
    rows = records.filter("trim(content) <> ''").select(F.col("record_id").alias("id"), embedded(text).alias("vector"))
    return rows.filter(F.exists("vector", lambda x: x != 0))


def known_vectors(records: DataFrame, c: Config) -> dict[str, DataFrame]:
    """The vectors that the dense streams need: computed once for all hops, and those of a text with its titles along with its own."""
    if not (c.dense and c.contextual):
        return {name: cut(vectors(records, name == "contextual")) for name, on in (("dense", c.dense), ("contextual", c.contextual)) if on}
    before = F.concat_ws(" ", *[x for x in ("document_title", "section_title") if x in records.columns])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = batch.slice(i, 4096)
                found = hashed_vectors(x.column("content").to_pylist(), SIZE, x.column("before").to_pylist())
                yield pa.RecordBatch.from_arrays([x.column("id"), *[pa.array(retrieval.small(v), pa.binary()) for v in found]], ["id", "dense", "contextual"])

    rows = records.filter("trim(content) <> ''").select(F.col("record_id").alias("id"), before.alias("before"), "content")
    known = cut(rows.mapInArrow(both, f"id {dict(rows.dtypes)['id']}, dense binary, contextual binary"))
    return {name: known.select("id", F.col(name).alias("vector")).filter("vector is not null") for name in ("dense", "contextual")}


def asked_vectors(questions: DataFrame) -> DataFrame:
    """(id, vector) of the questions that have words."""
    return questions.select(F.col("qid").alias("id"), embedded(F.col("question")).alias("vector")).filter(F.exists("vector", lambda x: x != 0))


def by_vector(questions: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k records with the nearest vectors to each question's; a question without words has none."""
    return retrieval.dense(asked_vectors(questions), known, k).select("qid", "chunk", "score", "rank")


def by_entities(questions: DataFrame, names: DataFrame | Gazette, said: DataFrame, k: int) -> DataFrame:
    named = gazette_matches(questions, names, "qid", "question", MOST_WORDS).select("qid", F.col("name").alias("entity"), F.lit(True).alias("exact"))
    return retrieval.entity_search(named, said.select(F.col("name").alias("entity"), "chunk", F.lit(1.0).alias("confidence")), k)


def streams(questions: DataFrame, records: DataFrame, names: DataFrame | Gazette, said: DataFrame, c: Config, known: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """The ranked lists that are switched on, in the order lexical, dense, contextual, entities; ``known``: the records' vectors, if they are there already."""
    known = known_vectors(records, c) if known is None else known
    found = []
    if c.lexical:
        found.append(retrieval.bm25(questions, records, "record_id", "content", c.bm25_k))
    if c.dense:
        found.append(by_vector(questions, known["dense"], c.dense_k))
    if c.contextual:
        found.append(by_vector(questions, known["contextual"], c.contextual_k))
    if c.entities:
        found.append(by_entities(questions, names, said, c.entity_k))
    return found


def as_lists(ranked: DataFrame) -> list[DataFrame]:
    """A ranked list in the form in which tasks find lists."""
    return [ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("less"), "chunk"))).alias("x")).select("qid", "x.less", "x.chunk")]


def retrieved(questions: DataFrame, records: DataFrame, names: DataFrame | Gazette, c: Config = Config(), said: DataFrame | None = None, more: tuple[tuple[DataFrame, int], ...] = (), documents: bool = False) -> DataFrame:
    """(qid, chunk, score, rank, before, and a hash of the ``document`` if wanted): fused, diversified (where there are more than ``k``), reranked. Records that are null in content, or of
    another category than the one that is set, aren't found. ``more``: further ranked lists (qid, chunk, rank) with their depths to fuse, before the others.

    The streams are those of ``streams``, from questions and texts that are stored as numbers, and fused from what tasks find."""
    records = of_category(records.filter("content is not null"), c)
    said = mentioned(records, names) if said is None else said
    terms = retrieval.encoded(questions, records, "record_id", "content", cut)
    found = [(as_lists(x), n) for x, n in more]
    if c.lexical:
        found.append((retrieval.bm25_lists(terms, c.bm25_k), c.bm25_k))
    if c.dense or c.contextual:
        known, asked = known_vectors(records, c), cut(asked_vectors(questions))
        found += [(retrieval.dense_lists(asked, known[name], k), k) for name, k in (("dense", c.dense_k), ("contextual", c.contextual_k)) if name in known]
    if c.entities:
        found.append((as_lists(by_entities(questions, names, said, c.entity_k)), c.entity_k))
    fused = retrieval.fused_lists(found, c.rrf_k, c.rrf_most).select("qid", "chunk", "rank")
    # documents are told apart only within the few rows of a question, for which 64 bits of a hash are enough
    document = F.xxhash64(F.coalesce("document_id", "document_title", F.lit("unknown")))
    diverse = diversified(fused.join(records.select(F.col("record_id").alias("chunk"), document.alias("document")), "chunk"), c)
    return retrieval.by_share(diverse, terms.questions, terms.texts.select("chunk", F.array_distinct("codes").alias("words")), max(c.pool, c.k), c.k, ("document",) * documents)


def of_category(records: DataFrame, c: Config) -> DataFrame:
    return records if c.category is None else records.filter(F.col("source_category") == c.category)


def diversified(ranked: DataFrame, c: Config) -> DataFrame:
    """Documents' shares bounded, for questions with more than ``k`` rows; others stay as they are."""
    rows = ranked.withColumn("turn", F.col("rank")).withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    rows = retrieval.diversified(rows, "document", c.per_document, c.preserve)
    return rows.withColumn("rank", F.when(F.col("n") > c.k, F.col("rank")).otherwise(F.col("turn"))).drop("turn", "n")


def together(said: DataFrame) -> DataFrame:
    """(a, b, chunk): the graph of names (chunk, name) that stand in one record, both ways, with the first such record of each pair.

    A record is a passage of bounded length, so the names paired within one are few, however many records there are.
    """
    x, y = said.select("chunk", F.col("name").alias("a")), said.select("chunk", F.col("name").alias("b"))
    return x.join(y, "chunk").filter("a <> b").repartition("a").groupBy("a", "b").agg(F.min("chunk").alias("chunk"))


def discovered(asked: DataFrame, edges: DataFrame, c: Config = Config()) -> DataFrame:
    """(qid, name, chunk, hops): the first ``paths`` names that trails of up to ``hops`` edges lead to from the names (qid, name) in each question,
    by hops and name, each with the record of its last edge. The names in the question itself are none of them.

    Names that are nearer come first, so no more than these few ever lead on to the next hop, however many edges a name has; and of a name's neighbours
    only as many, by name, as are wanted or can be left out because they are asked for or found already. A question with enough names has no further hop.
    """
    asked = asked.select("qid", "name").distinct()
    most = asked.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    near = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    edges = cut(edges.withColumn("near", near).filter(F.col("near") <= c.paths + most).drop("near"))
    found, at = None, asked
    for n in range(1, c.hops + 1):
        step = at.select("qid", F.col("name").alias("a")).join(edges, "a").groupBy("qid", F.col("b").alias("name")).agg(F.min("chunk").alias("chunk"))
        new = step.join(asked, ["qid", "name"], "left_anti").withColumn("hops", F.lit(n))
        if found is not None:
            new = found.unionByName(new.join(found.select("qid", "name"), ["qid", "name"], "left_anti"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy("hops", "name"))
        found = cut(new.withColumn("place", place).filter(F.col("place") <= c.paths))
        full = found.filter(F.col("place") == c.paths).select("qid")
        found = found.drop("place")
        at = found.filter(F.col("hops") == n).join(full, "qid", "left_anti")
    return found


def bridged(questions: DataFrame, found: DataFrame, c: Config = Config()) -> DataFrame:
    """(qid, question): second-hop questions: the first few names that were discovered (qid, name, hops), by hops and name, then the sub-questions but for
    the first, or the question if it has none. A question without such names or sub-questions has no second hop."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("hops", "name"))
    kept = found.select("qid", "name", place.alias("n")).filter(F.col("n") <= c.bridges)
    more = kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), " ").alias("names"))
    parts = sub_questions(F.col("question"))
    rows = questions.join(more, "qid", "left").withColumn("parts", parts).filter("names is not null or size(parts) > 1")
    rest = F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 2, 9), " ")).otherwise(F.col("question"))
    return rows.select("qid", F.concat_ws(" ", "names", rest).alias("question"))


def multi_hop(questions: DataFrame, records: DataFrame, names: DataFrame, c: Config = Config()) -> DataFrame:
    """(qid, chunk, rank): the first hop's records and those of the second hop by turns; of more than ``k`` those beyond a document's share go last, but for the first two.

    The second hop asks for the names that the graph of names leads to from those in the question and its sub-questions, and has the records of the edges
    passed on the way as a stream of its own. With a category set, the graph is that of its records. As it doesn't depend on what the first hop
    finds, the questions of both hops are numbered (``key``) and retrieved at once.
    """
    records = of_category(records, c)
    names = gazette(names, MOST_WORDS, cut)
    said = mentioned(records, names)
    parts = questions.select("qid", F.array_join(F.array_append(sub_questions(F.col("question")), F.col("question")), " . ").alias("question"))
    found = discovered(gazette_matches(parts, names, "qid", "question").select("qid", "name"), together(said), c)
    passed = found.groupBy("qid", "chunk").agg(F.min(F.struct("hops", "name")).alias("at")).select("qid", "chunk", F.row_number().over(Window.partitionBy("qid").orderBy("at", "chunk")).alias("rank"))
    hops = questions.select("qid", "question", F.lit(1).alias("hop")).unionByName(bridged(questions, found, c).withColumn("hop", F.lit(2)))
    hops = cut(hops.withColumn("key", F.monotonically_increasing_id()))
    passed = passed.join(hops.filter("hop = 2").select("qid", "key"), "qid").select(F.col("key").alias("qid"), "chunk", "rank")
    both = retrieved(hops.select(F.col("key").alias("qid"), "question"), records, names, c, said, ((passed, c.paths),), True).withColumnRenamed("qid", "key").join(hops.select("key", "qid", "hop"), "key")
    # by turns, in one shuffle
    every = both.select("qid", "chunk", "document", "rank", "hop").repartition("qid").groupBy("qid", "chunk", "document").agg(F.min(F.struct("rank", "hop")).alias("at"))
    every = every.select("qid", "chunk", "document", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("rank")).filter(F.col("rank") <= 2 * c.k)
    every = every.withColumn("turn", F.col("rank")).withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    diverse = retrieval.diversified(every, "document", c.per_document, 2)
    return diverse.select("qid", "chunk", F.when(F.col("n") > c.k, F.col("rank")).otherwise(F.col("turn")).alias("rank")).filter(F.col("rank") <= c.k)


def answers(questions: DataFrame, records: DataFrame, names: DataFrame, c: Config = Config()) -> DataFrame:
    """(qid, answer, level): what the retrieved evidence says about each question, cited by evidence number; where it isn't sufficient, a refusal."""
    read = [x for x in ("record_id", "content", "document_id", "document_title", "section_title", "source_category") if x in records.columns]
    # both stored: the streams read the records several times, and what follows the result
    found = cut(retrieved(questions, cut(records.select(*read)), names, c).select("qid", F.col("chunk").alias("record_id"), F.col("rank").alias("seq")))
    about = records.drop("qid", "score")
    numbered = found.join(about, "record_id").withColumn("evidence_id", F.format_string("EVIDENCE_%03d", "seq"))
    held = evidence.in_context(numbered, c.context_tokens).select("qid", "evidence_id")
    said = composed(numbered.join(held, ["qid", "evidence_id"]).join(questions, "qid").select("qid", "question", "evidence_id", "seq", "content"))
    level = evidence.sufficiency(questions, numbered).select("qid", "level")
    refusal = F.lit("The archive does not hold enough evidence to answer this question.")
    rows = questions.select("qid").join(level, "qid", "left").join(said, "qid", "left")
    return rows.select("qid", F.when((F.col("level") == "INSUFFICIENT") | F.col("answer").isNull(), refusal).otherwise(F.col("answer")).alias("answer"), "level")
