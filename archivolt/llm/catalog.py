"""The queries of this subpackage, and their SQL where SQL can say it over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archivolt.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.scans import noise

    return noise(table(spark, sf_dir, "page_contents"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.scans import repaired

    return repaired(table(spark, sf_dir, "page_contents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.pairs import defects

    return defects(table(spark, sf_dir, "hybrid_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.near_duplicates import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "evidence_records"), "record_id", "content").select("record_id", "group_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.top_n import top_n

    return top_n(table(spark, sf_dir, "evidence_records"), "document_id", "score", "record_id", 3).select("document_id", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.names import linked_names

    return linked_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "extracted_entities"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.neighbours import neighbour_pairs

    return neighbour_pairs(table(spark, sf_dir, "embedding_cache"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.containers import containers

    return containers(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.leaks import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.llm.sentences import sentences

    return sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p9_found": p9_found,
}

SQL: dict[str, str] = {
    "p3_found": r"""
        WITH RECURSIVE rows_ AS (SELECT record_id, any_value(content) AS content FROM evidence_records WHERE content IS NOT NULL GROUP BY record_id),
        words AS (SELECT record_id, unnest(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) AS w FROM rows_),
        sizes AS (SELECT record_id, count(*) AS n FROM words GROUP BY record_id),
        shared AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS both_ FROM words a JOIN words b ON a.w = b.w AND a.record_id < b.record_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.record_id = a JOIN sizes y ON y.record_id = b WHERE both_ >= 0.8 * (x.n + y.n - both_)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
        SELECT a AS record_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
    "p5_found": """
        WITH v AS (SELECT vec_id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM embedding_cache WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 11) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        k AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM s) WHERE place <= 5)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM k""",
    "p6_found": """
        SELECT document_id, record_id FROM (
            SELECT document_id, record_id, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, record_id) AS place
            FROM (SELECT DISTINCT document_id, record_id, score FROM evidence_records WHERE document_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)))
        WHERE place <= 3""",
    "p8_found": r"""
        WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        doc_runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM doc_words WHERE len(w) >= 10)),
        item_runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item_words WHERE len(w) >= 10))
        SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)""",
}
