"""Files of an archive: what their paths tell, Markdown sections, plates, native and scanned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Folders that are categories, picture formats, and files that are no sources.
CATEGORIES = ["chronicles", "wiki", "codex", "ephemera"]
PICTURES = ["png", "jpg", "jpeg"]
SKIPPED = ["README.txt", "sample_questions.json", ".DS_Store"]
# Kinds of picture that a file's name tells.
PICTURE_KINDS = "character|faction|location|conflict|creature|artifact"


def discovered(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, category, format, is_scan, stem) of every different path: pictures are category images, other files that of their
    first folder, if it is one, else ephemera. Hidden files and those that are no sources are left out; null paths too."""
    rows = files.select(F.col(path).alias("path")).filter("path is not null").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    first = F.split("path", "/")[0]
    category = F.when(ending.isin(PICTURES), "images").when(first.isin(CATEGORIES), first).otherwise("ephemera")
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"\.scan$", "")
    kept = rows.filter(~name.isin(SKIPPED) & ~name.startswith("."))
    return kept.select("path", category.alias("category"), ending.alias("format"), name.contains(".scan.").alias("is_scan"), stem.alias("stem"))


def bundled(found: DataFrame) -> DataFrame:
    """One row per document: its title, its files' number and formats, and the primary file (a docx or md one if there is, else the first)."""
    kept = found.filter(F.col("format").isin("pdf", "docx", "md", "txt"))
    order = F.struct(F.when(F.col("format").isin("docx", "md"), 0).otherwise(1), "path")
    return kept.groupBy("category", "stem").agg(F.min_by("path", order).alias("primary_path"), F.count("*").alias("representation_count"), F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats")).withColumn("title", F.initcap(F.regexp_replace("stem", "[_-]+", " ")))


def first_by_name(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(name, path): of files with one name the first path."""
    rows = files.select(F.col(path).alias("path")).filter("path is not null")
    return rows.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.min("path").alias("path"))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, title, level, content): the sections of each text, begun by heading lines; what stands before the
    first is section 0. Sections without content are left out, and so are null texts."""
    lines = F.split(F.col(text), "\n")
    marked = docs.select(F.col(key).alias(key), F.posexplode(lines).alias("at", "line")).withColumn("heading", F.col("line").rlike(r"^#{1,6}\s"))
    by = Window.partitionBy(key).orderBy("at")
    numbered = marked.withColumn("section_no", F.sum(F.col("heading").cast("int")).over(by))
    grouped = numbered.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("heading"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))).alias("title"),
        F.max(F.when(F.col("heading"), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))).otherwise(0)).alias("level"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("at", "line")))), lambda x: x.line), "\n")).alias("content"),
    )
    return grouped.filter("content <> ''")


def picture_kind(name: Column) -> Column:
    """(kind, subject) of a picture by its file's name."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    plate = F.regexp_extract(stem, r"^plate_[^_]+_[^_]+_(.+)$", 1)
    found = rf"^atmo_([a-z_]+?)_({PICTURE_KINDS})_(.+)$"
    kind = F.when(stem.startswith("plate_"), "figure_plate").when(stem.rlike(found), F.regexp_extract(stem, found, 2)).otherwise("illustration")
    subject = F.when(stem.startswith("plate_"), F.when(plate != "", plate).otherwise(F.regexp_replace(stem, "^plate_", ""))).when(stem.rlike(found), F.regexp_extract(stem, found, 3)).otherwise(stem)
    return F.struct(kind.alias("kind"), F.regexp_replace(subject, "_", " ").alias("subject"))


def plate_number(text: Column) -> Column:
    """A number as plates print it: dots between thousands (87.349 is 87349), else as it stands."""
    return F.when(text.rlike(r"^\d{1,3}\.\d{3}$"), F.regexp_replace(text, r"\.", "")).otherwise(F.regexp_replace(text, ",", "")).try_cast("double")


# What lines of a plate say: where it is from, its unit, and which labels are its main figure.
PROVENANCE = r"(?i)(entered into|codex|verified by|recorded by|as per)"
UNIT = r"(?i)(souls\s*under\s*arms|vitae-grains|vitae|souls\s*lost|per\s*the\s*vanguard\s*scale|of\s*\d+,\s*per)"
FIGURE = r"(?i)(threat\s*rating|garrison\s*strength|attunement\s*cost|defensive\s*rating|casualties|population|strategic\s*value)"


def plate_figures(plates: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, value, is_primary): the figures of each plate: a line that is a number belongs to the line before it.

    Lines that tell the provenance or the unit are no labels. A number without a label belongs to the last main figure named before,
    else to "Value". The first figure is the primary one. A label that comes again has its last value. Null texts have none.
    """
    lines = plates.select(F.col(key).alias(key), F.posexplode(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("spot", "line"))
    lines = lines.filter(~F.col("line").rlike(PROVENANCE) & ~F.col("line").rlike(UNIT))
    number = F.when(F.col("line").rlike(r"^[\d,.]+$") & F.col("line").rlike(r"\d"), plate_number(F.regexp_replace("line", ",", "")))
    by = Window.partitionBy(key).orderBy("spot")
    seen = lines.withColumn("number", number).withColumn("before", F.lag(F.when(F.col("number").isNull(), F.col("line"))).over(by))
    main = F.last(F.when(F.col("number").isNull() & F.col("line").rlike(FIGURE), F.col("line")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = seen.withColumn("label", F.coalesce("before", main, F.lit("Value"))).filter("number is not null")
    first = F.row_number().over(by) == 1
    found = found.withColumn("is_primary", first)
    return found.groupBy(key, "label").agg(F.max_by("number", "spot").alias("value"), F.max("is_primary").alias("is_primary"))


def plate_notes(plates: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, provenance): the last line of each plate that tells its unit, and the last that tells where it is from."""
    lines = plates.select(F.col(key).alias(key), F.posexplode(F.split(F.col(text), "\n")).alias("spot", "line")).withColumn("line", F.trim("line"))
    source = F.col("line").rlike(PROVENANCE)
    unit = F.when(F.col("line").rlike(r"(?i)souls\s*under\s*arms"), "souls under arms").when(F.col("line").rlike(r"(?i)souls\s*lost"), "souls lost").when(F.col("line").rlike("(?i)vitae-grains"), "vitae-grains").otherwise(F.col("line"))
    return lines.groupBy(key).agg(F.max_by(unit, F.when(~source & F.col("line").rlike(UNIT), F.col("spot"))).alias("unit"), F.max_by("line", F.when(source, F.col("spot"))).alias("provenance"))


def shown_document(name: Column) -> Column:
    """The stem of the document that a picture belongs to, by the name of its file: what follows the picture's prefix; null where there is none."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.when(stem.startswith("atmo_"), F.regexp_replace(stem, "^atmo_[a-z]+_[a-z]+_", "")).when(stem.startswith("plate_"), F.regexp_replace(stem, r"^plate_\d+_", ""))


def attached(pictures: DataFrame, documents: DataFrame, path: str = "path") -> DataFrame:
    """(path, id): each picture with the document (stem, id) it belongs to; null where there is none. Of several documents of one stem the first id."""
    known = documents.filter("stem is not null").groupBy("stem").agg(F.min("id").alias("id"))
    rows = pictures.select(F.col(path).alias("path")).filter("path is not null").distinct().withColumn("stem", shown_document(F.element_at(F.split("path", "/"), -1)))
    return rows.join(known, "stem", "left").select("path", "id")
