"""A property graph as tables of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import entity_id
from archivolt.operators.entities import distinct_mentions

# Fields of an information box, their relation, and whether it runs from the page to the field's name.
FIELDS = {
    "allegiance": ("MEMBER_OF", True), "affiliation": ("MEMBER_OF", True), "faction": ("MEMBER_OF", True), "ruler": ("RULED_BY", True), "leader": ("LED_BY", True),
    "location": ("LOCATED_IN", True), "region": ("LOCATED_IN", True), "allies": ("ALLIED_WITH", True), "enemies": ("ENEMY_OF", True), "members": ("MEMBER_OF", False), "seat": ("LOCATED_IN", True),
}


def cooccurrence(mentions: DataFrame, least: int = 1, examples: int = 20) -> DataFrame:
    """(a, b, weight, chunk_ids): pairs of entities, a < b, that are mentioned in ``least`` chunks or more together, with the first chunks.

    A chunk is a passage of bounded length, so the entities paired within one are few, however many chunks there are.
    """
    rows = distinct_mentions(mentions).filter("chunk_id is not null").select("chunk_id", "id").distinct()
    x, y = rows.select("chunk_id", F.col("id").alias("a")), rows.select("chunk_id", F.col("id").alias("b"))
    pairs = x.join(y, "chunk_id").filter("a < b")
    weights = pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    return weights.join(first_few(pairs, ["a", "b"], "chunk_id", examples, "chunk_ids"), ["a", "b"])


def first_few(rows: DataFrame, by: list[str], column: str, most: int, name: str) -> DataFrame:
    """(by..., name): the first ``most`` values of a column of each group, joined by commas: no more of them are ever gathered."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(column))
    few = rows.select(*by, column).withColumn("place", place).filter(F.col("place") <= most)
    return few.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(name))


def deduplicated(relations: DataFrame) -> DataFrame:
    """Relations (source, target, relation, confidence, seq): no self-loops, of equal ones in any case the first by seq."""
    rows = relations.filter("source is not null and target is not null and lower(source) <> lower(target)")
    best = rows.groupBy(F.lower("source").alias("s"), F.lower("target").alias("t"), "relation").agg(F.min_by(F.struct("source", "target", "confidence", "seq"), "seq").alias("b"))
    return best.select("b.source", "b.target", "relation", "b.confidence", "b.seq")


def infobox_relations(pages: DataFrame, title: str, text: str) -> DataFrame:
    """(source, relation, target): relations in the rows "| field | value |" of each page; names are linked in [[ ]] or listed with commas."""
    cells = pages.select(F.col(title).alias("page"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*\|([^|\n]+\|[^|\n]+)\|"))).alias("row"))
    field = F.lower(F.trim(F.regexp_replace(F.split("row", r"\|")[0], r"\*+", "")))
    value = F.split("row", r"\|")[1]
    linked = F.regexp_extract_all(value, F.lit(r"\[\[([^\]|]+)"))
    names = F.when(F.size(linked) > 0, linked).otherwise(F.split(value, "[;,]"))
    clean = F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"\*+|\[\[|\]\]", ""), r"\s*\([^)]*\)", "")))
    rows = cells.select("page", field.alias("field"), F.explode(F.filter(clean, lambda n: (n != "") & ~F.lower(n).isin("none", "unknown", "n/a"))).alias("name"))
    table = pages.sparkSession.createDataFrame([(k, r, f) for k, (r, f) in FIELDS.items()], "field string, relation string, forward boolean")
    met = rows.join(F.broadcast(table), "field")
    return met.select(F.when(F.col("forward"), F.col("page")).otherwise(F.col("name")).alias("source"), "relation", F.when(F.col("forward"), F.col("name")).otherwise(F.col("page")).alias("target")).filter("lower(source) <> lower(target)").distinct()


def stored(relations: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, confidence, seq): relations (source, target, relation, confidence, seq) between the nodes they mean.

    A name means the node that ``found`` (asked, id) says, else the one whose id is made from it. Relations that lack a name, are not a name in capitals, or of
    which an end is no node (``nodes``: id) are left out. One edge stands per relation and ends: the last by seq, and of equal ones the one most confident.
    """
    clean = relations.withColumn("relation", F.upper(F.trim("relation"))).filter("source <> '' and target <> '' and relation rlike '^[A-Z_][A-Z0-9_]*$'")
    said = found.groupBy("asked").agg(F.min("id").alias("id"))
    end = lambda df, name: df.join(said.select(F.col("asked").alias(name), F.col("id").alias("met")), name, "left").withColumn(f"{name}_id", F.coalesce("met", entity_id(F.col(name)))).drop("met")
    rows = end(end(clean, "source"), "target")
    there = nodes.select("id").distinct()
    rows = rows.join(there.withColumnRenamed("id", "source_id"), "source_id").join(there.withColumnRenamed("id", "target_id"), "target_id")
    last = F.struct("seq", "confidence", "source", "target")
    return rows.groupBy("source_id", "target_id", "relation").agg(F.max(last).alias("r")).select("source_id", "target_id", "relation", "r.confidence", "r.seq")


def undirected(edges: DataFrame) -> DataFrame:
    """(edge, a, b) in both directions."""
    return edges.select("edge", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("edge", F.col("dst").alias("a"), F.col("src").alias("b")))


def trails(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, hops, path): the trails (edges used once, nodes at will) of up to ``hops`` (at most 4) edges from each seed to other nodes.

    ``edges`` has (edge, src, dst), ``seeds`` (node). The joins are unrolled, one for each hop.
    """
    both = undirected(edges)
    at = seeds.select(F.col("node").alias("seed"), F.col("node").alias("node"), F.array("node").alias("nodes"), F.array().cast(f"array<{dict(edges.dtypes)['edge']}>").alias("used"))
    found = []
    for n in range(1, min(max(hops, 1), 4) + 1):
        at = at.join(both, at.node == both.a).filter("not array_contains(used, edge)").select("seed", F.col("b").alias("node"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("used", F.col("edge")).alias("used"))
        found.append(at.filter("seed <> node").select("seed", "node", F.lit(n).alias("hops"), F.array_join("nodes", " > ").alias("path")))
    return reduce(DataFrame.unionByName, found)


def reached(paths: DataFrame) -> DataFrame:
    """(seed, node, hops, paths): every node that trails lead to, with the fewest hops and the number of different paths."""
    return paths.groupBy("seed", "node").agg(F.min("hops").alias("hops"), F.count_distinct("path").alias("paths"))


def related(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, neighbour): the different neighbours of nodes."""
    both = undirected(edges)
    return names.select("node").distinct().join(both, F.col("node") == F.col("a")).select("node", F.col("b").alias("neighbour")).distinct()


def hydrated(ids: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(chunk_id, content, document_title, source_category): the chunks of a table of ids, each once, with their documents where these are known."""
    rows = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("content", "document_id"), "record_id").alias("c")).select("chunk_id", "c.content", "c.document_id")
    asked = ids.select("chunk_id").filter("chunk_id is not null").distinct().join(rows, "chunk_id")
    about = docs.select(F.col("id").alias("document_id"), "title", "source_category")
    return asked.join(about, "document_id", "left").select("chunk_id", "content", F.coalesce("title", F.lit("Visual Archive Asset")).alias("document_title"), F.coalesce("source_category", F.lit("images")).alias("source_category"))


def checked(edges: DataFrame) -> DataFrame:
    """The same edges; a relation that isn't a name in capitals ends the query with an error."""
    named = F.coalesce(F.col("relation").rlike("^[A-Z_][A-Z0-9_]*$"), F.lit(False))
    return edges.withColumn("relation", F.when(named, F.col("relation")).otherwise(F.raise_error(F.concat(F.lit("not a relation: "), F.coalesce("relation", F.lit("null")))).cast("string")))
