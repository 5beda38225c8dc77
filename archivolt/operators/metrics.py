"""Retrieval metrics, grounding of citations, experiments side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_hits(results: DataFrame, relevant: DataFrame, key: str = "result_id", chunks: str = "retrieved_chunk_ids") -> DataFrame:
    """(key, first): the rank (from 1) of the first retrieved chunk of each result that is relevant (a table chunk_id), null if none is."""
    good = relevant.select("chunk_id").filter("chunk_id is not null").distinct().withColumn("hit", F.lit(1))
    rows = results.select(F.col(key), F.posexplode_outer(chunks).alias("at", "chunk_id")).join(good, "chunk_id", "left")
    return rows.groupBy(key).agg(F.min(F.when(F.col("hit") == 1, F.col("at") + 1)).alias("first"))


def recall_and_mrr(hits: DataFrame, key: str = "result_id", ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(key, hit_at_k..., mrr) of each result."""
    at = [F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in ks]
    return hits.select(key, *at, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"))


def joint_recall(items: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(qid, joint): 1.0 if every hop of a question (qid, hop, target) is matched within the first k items (qid, rank, document, text),
    two hops in different documents. Targets are looked for in any case in the text."""
    hops = targets.select("qid", "hop", F.lower("target").alias("target"))
    met = items.filter(F.col("rank") <= k).join(hops, "qid").filter(F.expr("contains(lower(text), target)")).select("qid", "hop", "document").distinct()
    counts = hops.groupBy("qid").agg(F.count_distinct("hop").alias("hops"))
    # hops can be given different documents if and only if any set of hops has as many documents between them as it has hops;
    # a question has few hops and k items, so what is gathered is small
    number = F.dense_rank().over(Window.partitionBy("qid").orderBy("hop")) - 1
    numbered = met.join(hops.select("qid", "hop").distinct().withColumn("i", number), ["qid", "hop"])
    per = numbered.groupBy("qid").agg(F.collect_list(F.struct("i", "document")).alias("met"))
    rows = counts.join(per, "qid", "left")
    enough = F.expr("forall(sequence(1L, shiftleft(1L, cast(hops as int)) - 1), s -> size(array_distinct(transform(filter(met, x -> (shiftright(s, x.i) & 1) = 1), x -> x.document))) >= bit_count(s))")
    return rows.select("qid", F.when(F.coalesce(enough, F.lit(False)), 1.0).otherwise(0.0).alias("joint"))


def grounding(results: DataFrame, documents: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, cited, grounded): citations of each result, and those that have an excerpt and the title of a known document."""
    known = documents.select(F.col("title").alias("t")).filter("t is not null").distinct().withColumn("known", F.lit(1))
    rows = results.select(F.col(key), F.explode("citations").alias("c")).select(key, F.col("c.document_title").alias("t"), F.trim(F.coalesce("c.excerpt", F.lit(""))).alias("excerpt"))
    good = F.when((F.col("known") == 1) & (F.col("excerpt") != ""), 1).otherwise(0)
    return rows.join(known, "t", "left").groupBy(key).agg(F.count("*").alias("cited"), F.sum(good).alias("grounded"))


def by_experiment(results: DataFrame) -> DataFrame:
    """The averages of each experiment, to six decimals; runs delivered twice count once (by question and experiment, the latest)."""
    cols = ["recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "total_time_sec"]
    last = results.groupBy("qid", "experiment").agg(F.max_by(F.struct(*cols, "citation_grounded"), F.struct("run_at", "result_id")).alias("r"))
    return last.groupBy("experiment").agg(F.count("*").alias("questions"), *[F.round(F.avg(f"r.{c}"), 6).alias(c) for c in cols], F.round(F.avg(F.col("r.citation_grounded").cast("int")), 6).alias("grounded"))


def compared(results: DataFrame, one: str, other: str) -> DataFrame:
    """(qid, mrr_one, mrr_other, change): the questions that two experiments both answered."""
    last = results.groupBy("qid", "experiment").agg(F.max_by("mrr", F.struct("run_at", "result_id")).alias("mrr"))
    x, y = last.filter(F.col("experiment") == one).select("qid", F.col("mrr").alias("mrr_one")), last.filter(F.col("experiment") == other).select("qid", F.col("mrr").alias("mrr_other"))
    return x.join(y, "qid").withColumn("change", F.when(F.col("mrr_other") > F.col("mrr_one"), "improved").when(F.col("mrr_other") < F.col("mrr_one"), "worse").otherwise("same"))


def support(results: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, numbers, found, supported): numbers of an answer, those that its cited excerpts hold too, and whether the excerpts support it:
    there is an answer with citations, and of its numbers at least one is found."""
    numbers = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:,\d+)?)(?![\p{L}\p{N}_])"))
    excerpts = F.lower(F.array_join(F.transform(F.coalesce("citations", F.array()), lambda c: F.coalesce(c.excerpt, F.lit(""))), " "))
    rows = results.select(F.col(key), numbers.alias("n"), excerpts.alias("said"), (F.coalesce(F.size("citations"), F.lit(0)) > 0).alias("cites"), (F.coalesce("answer", F.lit("")) != "").alias("answers"))
    found = F.size(F.filter("n", lambda x: F.contains(F.col("said"), x) | F.contains(F.col("said"), F.replace(x, F.lit(","), F.lit("")))))
    rows = rows.withColumn("found", found)
    return rows.select(key, F.size("n").alias("numbers"), "found", (F.col("cites") & F.col("answers") & ((F.size("n") == 0) | (F.col("found") > 0))).alias("supported"))


def assets_for(questions: DataFrame, assets: DataFrame) -> DataFrame:
    """(qid, asset_id): assets whose entity (of more than three characters, without quotation marks) a question names word by word.

    The names are matched as runs of words on equality, so neither side is paired with all of the other.
    """
    from archivolt.operators.entities import gazette_matches

    name = F.trim(F.regexp_replace("entity_name", "[\"'“”]", ""))
    named = assets.select("asset_id", name.alias("name")).filter("length(name) > 3")
    hits = gazette_matches(questions, named, "qid", "question", most=6).select("qid", F.lower("name").alias("said"))
    return hits.join(named.withColumn("said", F.lower("name")), "said").select("qid", "asset_id").distinct()
