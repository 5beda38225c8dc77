"""Chunks of documents, what stands around them, and checks of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import pronouns, token_count


def _bare(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _fold(paragraphs: Column, most: int, overlap: int) -> Column:
    """Paragraphs gathered up to ``most`` tokens; a chunk begins with the last paragraphs of the one before, up to ``overlap`` tokens."""
    pieces = F.transform(F.filter(F.transform(paragraphs, _bare), lambda p: p != ""), lambda p: F.struct(p.alias("p"), token_count(p).alias("n")))
    kind = "array<struct<p:string,n:int>>"
    start = F.struct(F.array().cast(kind).alias("held"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("done"))

    def tail(held: Column) -> Column:
        # the longest run of paragraphs from the end that fits the overlap
        back = F.aggregate(
            F.reverse(held),
            F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("size"), F.lit(True).alias("going")),
            lambda a, x: F.when(a.going & (a.size + x.n <= overlap), F.struct(F.concat(F.array(x), a.kept).alias("kept"), (a.size + x.n).alias("size"), F.lit(True).alias("going"))).otherwise(F.struct(a.kept.alias("kept"), a.size.alias("size"), F.lit(False).alias("going"))),
        )
        return back

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a.held) > 0) & (a.size + x.n > most)
        seed = tail(a.held)
        held = F.when(full, seed.kept).otherwise(a.held)
        size = F.when(full, seed["size"]).otherwise(a.size)
        done = F.when(full, F.array_append(a.done, F.array_join(F.transform(a.held, lambda y: y.p), "\n\n"))).otherwise(a.done)
        return F.struct(F.array_append(held, x).alias("held"), (size + x.n).alias("size"), done.alias("done"))

    folded = F.aggregate(pieces, start, step)
    return F.when(F.size(folded.held) > 0, F.array_append(folded.done, F.array_join(F.transform(folded.held, lambda y: y.p), "\n\n"))).otherwise(folded.done)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 512, overlap: int = 100, between: str = r"\n\s*\n") -> DataFrame:
    """(key, position, chunk, token_count): each text's chunks of paragraphs, in order, from position 0.

    A paragraph of more than ``most`` tokens is a chunk by itself (with the overlap before it). Null and blank texts have no chunks.
    """
    pieces = docs.select(F.col(key).alias(key), F.posexplode(_fold(F.split(F.col(text), between), most, overlap)).alias("position", "chunk"))
    return pieces.withColumn("token_count", token_count(F.col("chunk")))


def chunks_by_category(docs: DataFrame, key: str = "doc_id", most: int = 512, overlap: int = 100) -> DataFrame:
    """(key, position, section_title, chunk, token_count, page, line_start, line_end): each document's chunks as its category asks.

    ``docs`` has (key, title, source_category, text). The wiki is cut at headings, and a section into paragraphs only if it has more than ``most`` tokens;
    chronicles and the codex at headings, each section into paragraphs with overlap; before the codex's sections its tables (rows "| a | b |") stand whole,
    as chunks "Table: title"; other texts are paragraphs under their title. Positions run through a document; page and line are estimates from the position
    (lines for the wiki only, else null). Null and blank texts have no chunks. Nothing is shuffled: a document is cut up where it is read.
    """
    category = F.lower(F.coalesce("source_category", F.lit("")))
    paragraphs = lambda t: _fold(F.split(t, "\n\n"), most, overlap)
    piece = lambda title, t: F.struct(title.alias("section_title"), t.alias("chunk"), t.alias("counted"))
    none = F.array().cast("array<struct<section_title:string,chunk:string,counted:string>>")
    sections = F.transform(F.split("text", r"(?m)^(?=#{1,6}\s)"), lambda s: F.struct(F.nullif(F.trim(F.regexp_extract(s, r"^#{1,6}\s+([^\n]*)", 1)), F.lit("")).alias("title"), _bare(F.regexp_replace(s, r"^#{1,6}\s[^\n]*\n?", "")).alias("body")))
    sections = F.filter(sections, lambda s: s["body"].rlike(r"\S"))
    of_section = lambda s: F.transform(paragraphs(s["body"]), lambda c: piece(s["title"], c))
    whole = lambda s: F.array(piece(s["title"], s["body"]))
    cells = lambda row: F.array_join(F.transform(F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), " | ")
    tables = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)((?:^[ \t]*\|[^\n]*\|[ \t]*(?:\n|$))+)")), lambda t: F.array_join(F.transform(F.filter(F.split(t, "\n"), lambda r: r.rlike(r"\S")), cells), "\n"))
    tabled = F.transform(tables, lambda t: F.struct(F.lit("Data Table").alias("section_title"), F.concat(F.lit("Table: "), F.coalesce("title", F.lit("")), F.lit("\n"), t).alias("chunk"), t.alias("counted")))
    cut_up = (
        F.when(category == "wiki", F.flatten(F.transform(sections, lambda s: F.when(token_count(s["body"]) > most, of_section(s)).otherwise(whole(s)))))
        .when(category == "chronicles", F.flatten(F.transform(sections, of_section)))
        .when(category == "codex", F.concat(tabled, F.flatten(F.transform(sections, of_section))))
        .otherwise(F.transform(paragraphs(_bare(F.col("text"))), lambda c: piece(F.col("title"), c)))
    )
    rows = docs.filter(F.col("text").rlike(r"\S")).select(F.col(key).alias(key), category.alias("category"), F.posexplode(F.coalesce(cut_up, none)).alias("position", "c")).select(key, "category", "position", "c.*")
    start = F.when(F.col("category") == "wiki", F.col("position") * 25 + 1)
    lines = F.greatest(F.lit(1), F.size(F.split("chunk", "\n")))
    return rows.select(key, "position", "section_title", "chunk", token_count(F.col("counted")).alias("token_count"), F.greatest(F.lit(1), F.floor(F.col("position") / 2).cast("int") + 1).alias("page"), start.alias("line_start"), (start + lines).alias("line_end"))


def picture_chunk(name: Column, kind: Column, description: Column, figures: Column) -> Column:
    """A text that stands for a picture in retrieval: whom it shows, its kind, its description and its figures (a map); what is null or empty is left out."""
    listed = F.array_join(F.transform(F.map_entries(figures), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Visual Archive Record: "), F.coalesce(F.nullif(name, F.lit("")), F.lit("Artwork"))),
        F.concat(F.lit("Asset Type: "), F.initcap(F.regexp_replace(kind, "_", " "))),
        F.concat(F.lit("Description: "), F.nullif(description, F.lit(""))),
        F.concat(F.lit("Recorded Data: "), F.nullif(listed, F.lit(""))),
    )


def prefixes(chunked: DataFrame, title: str, section: str, names: str) -> DataFrame:
    """Adds ``prefix``: where a chunk stands and who is named in it. ``names`` is an array of struct(name, type); nulls and repetitions are dropped."""
    said = F.array_distinct(F.transform(F.filter(F.col(names), lambda e: e["name"].isNotNull()), lambda e: F.concat(F.trim(e["name"]), F.lit(" ["), F.initcap(F.coalesce(e["type"], F.lit("unknown"))), F.lit("]"))))
    where = F.concat_ws(", ", F.concat(F.lit("From "), F.nullif(F.trim(title), F.lit(""))), F.concat(F.lit("Section: "), F.nullif(F.trim(section), F.lit(""))))
    whole = F.concat(where, F.when(where != "", ".").otherwise(""), F.when(F.size(said) > 0, F.concat(F.lit(" Entities: "), F.array_join(said, ", "), F.lit("."))).otherwise(""))
    return chunked.withColumn("prefix", F.trim(whole))


def needs_context(text: Column, entities: Column) -> Column:
    """Whether a chunk can't be understood by itself: long enough, at most one entity, two pronouns or more."""
    return (F.length(text) >= 30) & (entities <= 1) & (pronouns(text) >= 2)


def neighbours(rows: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """Adds ``previous`` and ``following``: the texts before and after, within the group."""
    by = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("previous", F.lag(text).over(by)).withColumn("following", F.lead(text).over(by))


def archive_report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per source category: documents, those without pages, empty ones, and those that begin like another."""
    paged = pages.select(F.col("document_id").alias("id")).filter("id is not null").distinct().withColumn("paged", F.lit(1))
    rows = docs.select("id", "source_category", F.coalesce(F.trim("text"), F.lit("")).alias("text")).join(paged, "id", "left")
    return rows.groupBy("source_category").agg(
        F.count("*").alias("documents"),
        F.sum(F.when(F.col("paged").isNull(), 1).otherwise(0)).alias("without_pages"),
        F.sum(F.when(F.col("text") == "", 1).otherwise(0)).alias("empty"),
        (F.count(F.when(F.col("text") != "", 1)) - F.count_distinct(F.when(F.col("text") != "", F.substring("text", 1, 100)))).alias("repeated"),
    )


def locations(passages: DataFrame, docs: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, paragraph, line): where each passage's first 45 characters stand in its document, counted from 1; null where they don't.

    Passages whose document isn't there are left out; a passage delivered several times has one row.
    """
    snippet = F.lower(F.substring(F.trim("content"), 1, 45))
    rows = passages.select(F.col(key), F.col("document_id").alias("id"), snippet.alias("snippet")).filter("snippet <> ''").distinct()
    text = F.regexp_replace(F.lower("text"), r"[ ]+", " ")
    found = rows.join(docs.select("id", text.alias("text")), "id")
    at = F.expr("instr(text, snippet)")
    before = F.expr("substring(text, 1, instr(text, snippet) - 1)")
    return found.select(key, F.when(at > 0, F.size(F.split(before, r"\n\n+"))).alias("paragraph"), F.when(at > 0, F.size(F.split(before, "\n"))).alias("line"))
