"""Evidence: registration, sources, conflicts, sufficiency, contexts, citations, claims, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import STOP_WORDS

# What a file's name tells of a source: prefix -> (type, subtype, claim strength, voice, reliability in time).
PREFIXES = {
    "ballad_concerning_": ("ephemera", "ballad", "rumor", "in_character", "mythological"),
    "trial_transcript_": ("ephemera", "trial_transcript", "allegation", "official", "contemporary"),
    "sermon_concerning_": ("ephemera", "sermon", "assertion", "in_character", "retrospective"),
    "field_report_": ("ephemera", "field_report", "observation", "official", "contemporary"),
    "letter_concerning_": ("ephemera", "letter", "personal", "personal", "contemporary"),
    "decree_concerning_": ("ephemera", "decree", "decree", "official", "contemporary"),
    "interrogation_record_": ("ephemera", "interrogation_record", "allegation", "official", "contemporary"),
    "petition_concerning_": ("ephemera", "petition", "assertion", "personal", "contemporary"),
    "contract_concerning_": ("ephemera", "contract", "assertion", "official", "contemporary"),
    "auction_catalogue_": ("ephemera", "auction_catalogue", "observation", "official", "contemporary"),
    "muster_roll_": ("ephemera", "muster_roll", "assertion", "official", "contemporary"),
    "quartermaster_ledger_": ("ephemera", "quartermaster_ledger", "observation", "official", "contemporary"),
}
TRAITS = ("source_type", "document_subtype", "claim_strength", "narrative_voice", "temporal_reliability")
# Words of opposite tenor.
OPPOSED = [
    (["betray", "betrayal", "betrayed", "traitor", "treason", "accused", "alleged", "charged", "guilty"], ["loyal", "loyalty", "faithful", "never wavered", "denied", "innocent", "unbroken", "steadfast"]),
    (["won", "victorious", "triumphed", "prevailed"], ["lost", "defeated", "fallen", "crushed", "failed"]),
    (["killed", "slain", "murdered", "executed", "died"], ["survived", "escaped", "lived", "endured", "alive"]),
]
# Rules of claims: pattern, predicate, strength.
CLAIMS = [
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:was\s+)?(?:accused\s+of|charged\s+with)\s+([^.,;]+)", "accused_of", "allegation"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:was\s+)?rumored\s+to\s+(?:have\s+)?([^.,;]+)", "rumored_to_have", "rumor"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:was\s+)?claimed\s+to\s+be\s+([^.,;]+)", "claimed_to_be", "allegation"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:founded|established)\s+(?:the\s+)?([^.,;]+)", "founded", "assertion"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:destroyed|shattered|razed)\s+(?:the\s+)?([^.,;]+)", "destroyed", "assertion"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:committed|perpetrated)\s+([^.,;]+)", "committed", "assertion"),
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:was\s+a\s+member\s+of|belonged\s+to)\s+(?:the\s+)?([^.,;]+)", "member_of", "assertion"),
]
# Words that begin sentences without being names.
CONNECTORS = (
    "the and but in at on ser lord lady while however although whereas according furthermore moreover as this that these those when where if there based some both all each one two three with "
    "from into over after before ballad ballads record records trial trials codex annals archive"
).split()
SMALL = "the and a an in on at to for of with from by as is was were be been are that this these those it its or which who whom".split()


def once(records: DataFrame) -> DataFrame:
    """Evidence without records delivered again: of each record_id the row registered first."""
    others = [c for c in records.columns if c != "record_id"]
    best = records.groupBy("record_id").agg(F.min_by(F.struct(*others), F.struct(F.col("registered_at").isNull().cast("int"), "registered_at")).alias("r"))
    return best.select("record_id", *[F.col(f"r.{c}").alias(c) for c in others])


def traits(file: Column, category: Column) -> Column:
    """The traits of a source by its file's name and its category."""
    stem = F.lower(F.trim(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?i)(\.scan)?\.(pdf|docx|md|txt|png|jpe?g)$", "")))
    kind = F.lower(F.coalesce(category, F.lit("")))

    def of(values: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(TRAITS, values, strict=True)])

    found = F.when(stem.startswith("wiki_") | (kind == "wiki") | file.contains("/wiki/"), of(("wiki", "wiki_article", "assertion", "third_party", "retrospective")))
    found = found.when(stem.startswith("codex_") | (kind == "codex") | file.contains("/codex/"), of(("codex", "codex_entry", "assertion", "official", "retrospective")))
    found = found.when(stem.contains("chronicle") | (kind == "chronicles") | file.contains("/chronicles/"), of(("chronicle", "chronicle_entry", "assertion", "narrative", "retrospective")))
    found = found.when(kind == "ephemera", of(("ephemera", "unknown", "assertion", "third_party", "retrospective"))).otherwise(of(("unknown", "unknown", "assertion", "third_party", "retrospective")))
    for prefix, values in PREFIXES.items():
        found = F.when(stem.startswith(prefix), of(values)).otherwise(found)
    return found


def registered(records: DataFrame) -> DataFrame:
    """Evidence with ``seq`` (by score, best first, then record_id; null and NaN scores last) and ``evidence_id`` within its qid."""
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    seq = F.row_number().over(Window.partitionBy("qid").orderBy(score.desc_nulls_last(), "record_id"))
    return records.withColumn("seq", seq).withColumn("evidence_id", F.format_string("EVIDENCE_%03d", F.col("seq")))


def first_of_chunk(numbered: DataFrame) -> DataFrame:
    """Of the evidence of one chunk within a qid the first; numbers keep their gaps. Evidence without a chunk stays."""
    first = F.row_number().over(Window.partitionBy("qid", F.coalesce("chunk_id", F.concat(F.lit("#"), F.col("record_id").cast("string")))).orderBy("seq"))
    return numbered.withColumn("n", first).filter("n = 1").drop("n")


def diversity(records: DataFrame) -> DataFrame:
    """(qid, total, documents, categories, subtypes) of the evidence of each question."""
    return records.groupBy("qid").agg(F.count("*").alias("total"), F.count_distinct(F.coalesce("document_title", "document_id")).alias("documents"), F.count_distinct("source_category").alias("categories"), F.count_distinct("source_subtype").alias("subtypes"))


def conflicts(records: DataFrame) -> DataFrame:
    """(qid, tenor, against, in_favour, pairs, first_against, first_in_favour): for each pair of opposite word sets, the evidence on both sides.

    The disagreeing pairs of a question are all those with one record from each side, so they are counted, with a
    representative from each, and not written out. A record on both sides opposes all others of either side.
    """
    text = F.lower(F.concat_ws(" ", "content", "source_characteristics.claim_strength"))
    has = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(F.col("text"), w))
    rows = records.select("qid", "record_id", text.alias("text")).filter("qid is not null")
    rows = rows.select("qid", "record_id", F.explode(F.array(*[F.struct(F.lit(i).alias("tenor"), has(n).alias("n"), has(p).alias("p")) for i, (n, p) in enumerate(OPPOSED)])).alias("s")).select("qid", "record_id", "s.*").filter("n or p")
    n, p = F.col("n").cast("long"), F.col("p").cast("long")
    sums = rows.groupBy("qid", "tenor").agg(F.sum(n).alias("against"), F.sum(p).alias("in_favour"), F.sum(n * p).alias("both"), F.min(F.when(F.col("n"), F.col("record_id"))).alias("first_against"), F.min(F.when(F.col("p"), F.col("record_id"))).alias("first_in_favour"))
    only_n, only_p, both = F.col("against") - F.col("both"), F.col("in_favour") - F.col("both"), F.col("both")
    pairs = only_n * only_p + both * (only_n + only_p) + (both * (both - 1) / 2).cast("long")
    return sums.withColumn("pairs", pairs).filter("pairs > 0").drop("both")


def sufficiency(questions: DataFrame, numbered: DataFrame) -> DataFrame:
    """(qid, records, documents, coverage, level): whether a question's ten best records name what it names."""
    names = F.filter(F.regexp_extract_all(F.col("question"), F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)")), lambda w: F.length(w) > 2)
    plain = F.filter(F.regexp_extract_all(F.col("question"), F.lit(r"([A-Za-z]{4,})")), lambda w: ~F.lower(w).isin(STOP_WORDS))
    asked = questions.select("qid", F.when(F.size(names) > 0, names).otherwise(plain).alias("names"))
    # the ten best only are gathered
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") <= 10, F.struct("seq", F.lower(F.concat_ws(" ", "document_title", "content")).alias("t"))))), lambda x: x.t), " ")
    known = numbered.groupBy("qid").agg(F.count("*").alias("records"), F.greatest(F.count_distinct("document_id"), F.count_distinct("document_title")).alias("documents"), text.alias("text"))
    rows = asked.join(known, "qid", "left").withColumn("records", F.coalesce("records", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    found = F.size(F.filter("names", lambda w: F.contains(F.coalesce("text", F.lit("")), F.lower(w))))
    coverage = F.when((F.size("names") == 0) | (F.col("records") == 0), 0.0).otherwise(F.round(found / F.size("names"), 4))
    rows = rows.withColumn("coverage", coverage)
    level = F.when(F.col("coverage") < 0.35, "INSUFFICIENT").when((F.col("documents") >= 2) & (F.col("coverage") >= 0.7), "HIGH").when((F.col("documents") >= 1) & (F.col("coverage") >= 0.45), "MEDIUM").otherwise("LOW")
    return rows.select("qid", "records", "documents", "coverage", level.alias("level"))


def state_sufficiency(states: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, records, documents, missing, coverage, level): whether what was gathered for a question bears an answer.

    ``states`` has (qid, kind, names, hops): the question's type, the names in it and how many hops found something; ``items`` (qid, rank, document_id,
    document_title, content). The names must stand in the ten best; composed questions also need two documents and two hops. A question for which nothing
    was gathered has coverage 0 and is INSUFFICIENT; one without names has none missing.
    """
    ten = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", F.lower(F.concat_ws(" ", "document_title", "content")).alias("t"))))), lambda x: x.t), " ")
    have = items.groupBy("qid").agg(F.count("*").alias("records"), F.greatest(F.count_distinct("document_id"), F.count_distinct("document_title")).alias("documents"), ten.alias("text"))
    rows = states.join(have, "qid", "left").withColumn("records", F.coalesce("records", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    rows = rows.withColumn("missing", F.size(F.filter("names", lambda n: ~F.contains(F.coalesce("text", F.lit("")), F.lower(n)))))
    held = 1 - F.col("missing") / F.greatest(F.size("names"), F.lit(1))
    of = lambda level, coverage: F.struct(F.lit(level).alias("level"), F.lit(coverage).alias("coverage"))
    composed = F.when((F.col("documents") >= 2) & (held >= 0.8) & (F.col("hops") >= 2), of("HIGH", 0.95)).when((F.col("documents") >= 2) & (held >= 0.5), of("MEDIUM", 0.65)).when((F.col("documents") >= 1) & (held >= 0.5), of("LOW", 0.4)).otherwise(of("INSUFFICIENT", 0.1))
    plain = F.when(held >= 0.8, of("HIGH", 1.0)).when(held >= 0.5, of("MEDIUM", 0.6)).otherwise(of("LOW", 0.3))
    said = F.when(F.col("records") == 0, of("INSUFFICIENT", 0.0)).when(F.col("kind") == "multi_hop", composed).otherwise(plain)
    return rows.withColumn("s", said).select("qid", "records", "documents", "missing", "s.coverage", "s.level")


def claims(records: DataFrame, key: str = "record_id", text: str = "content") -> DataFrame:
    """(key, claim_no, subject, predicate, object, strength): what the rules find in each text, numbered by rule and place."""
    rows = records.select(F.col(key), F.col(text).alias("text"), F.coalesce("source_characteristics.claim_strength", F.lit("assertion")).alias("own"))

    def by_rule(pattern: str, predicate: str, strength: str) -> Column:
        of = lambda group: F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(group))
        return F.zip_with(of(1), of(2), lambda s, o: F.struct(s.alias("s"), o.alias("o"), F.lit(predicate).alias("p"), F.lit(strength).alias("w")))

    each = [by_rule(*rule) for rule in CLAIMS]
    found = rows.select(key, "own", F.posexplode(F.concat(*each)).alias("at", "c"))
    subject = F.trim(F.regexp_replace(F.trim("c.s"), r"(?i)\s+\b(was|is|were|are|been|had)\b.*$", ""))
    return found.select(key, (F.col("at") + 1).alias("claim_no"), subject.alias("subject"), F.col("c.p").alias("predicate"), F.trim("c.o").alias("object"), F.when(F.col("c.w") != "assertion", F.col("c.w")).otherwise(F.col("own")).alias("strength"))


def in_context(numbered: DataFrame, most: float = 3500.0) -> DataFrame:
    """(qid, evidence_id, tokens, total): the evidence that a context of ``most`` tokens holds: from the first on, up to the first that exceeds it (the first always)."""
    size = F.round(F.size(F.filter(F.split(F.trim("content"), r"\s+"), lambda w: w != "")) * 1.3, 1)
    total = F.round(F.sum("tokens").over(Window.partitionBy("qid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)), 1)
    return numbered.withColumn("tokens", size).withColumn("total", total).filter((F.col("total") <= most) | (F.col("seq") == 1)).select("qid", "evidence_id", "tokens", "total")


def cited(answers: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, qid, at, number): the citations of each answer, in order."""
    found = F.regexp_extract_all("answer", F.lit(r"EVIDENCE_(\d+)"))
    return answers.select(F.col(key), "qid", F.posexplode(found).alias("at", "n")).select(key, "qid", "at", F.col("n").cast("long").alias("number"))


def citation_issues(answers: DataFrame, records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, number, issue): cited numbers that the question has no evidence for, or whose content is empty."""
    have = records.select("qid", F.regexp_extract("id", r"(\d+)", 1).try_cast("long").alias("number"), F.trim(F.coalesce("content", F.lit(""))).alias("content")).filter("number is not null").groupBy("qid", "number").agg(F.max(F.length("content")).alias("size"))
    rows = cited(answers, key).join(have, ["qid", "number"], "left")
    return rows.filter("size is null or size = 0").select(key, "number", F.when(F.col("size").isNull(), "missing").otherwise("unsupported").alias("issue"))


def place_of(page: Column, metadata: Column) -> Column:
    """Where a record stands: a plate, a named place, page with lines or paragraph, a line, else page 1."""
    get = lambda k: F.get_json_object(metadata, f"$.{k}")
    first, last, para, named = get("line_start"), get("line_end"), get("paragraph_start"), get("reference_location")
    at = F.concat(F.lit("p."), page.cast("string"))
    return F.when((first == "Plate") | (get("is_asset_chunk") == "true"), "Plate").when(named.isNotNull(), named).when(page.isNotNull() & first.isNotNull() & last.isNotNull(), F.concat(at, F.lit(" (Lines "), first, F.lit("-"), last, F.lit(")"))).when(page.isNotNull() & para.isNotNull(), F.concat(at, F.lit(" (Para "), para, F.lit(")"))).when(page.isNotNull(), at).when(first.isNotNull(), F.concat(F.lit("Line "), first)).otherwise("p.1")


def resolved(answers: DataFrame, records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, answer): answers with their citations written out as title and place; those without a record stay."""
    said = F.concat(F.coalesce("document_title", F.lit("Archive Document")), F.lit(", "), place_of(F.col("page"), F.col("metadata")))
    have = records.select("qid", F.regexp_extract("id", r"(\d+)", 1).try_cast("long").alias("number"), "record_id", said.alias("said")).filter("number is not null").groupBy("qid", "number").agg(F.min_by("said", "record_id").alias("said"))
    pieces = answers.select(F.col(key), "qid", F.posexplode(F.regexp_extract_all("answer", F.lit(r"(EVIDENCE_\d+|(?:(?!EVIDENCE_\d)[\s\S])+)"))).alias("at", "piece"))
    pieces = pieces.withColumn("number", F.regexp_extract("piece", r"^EVIDENCE_(\d+)$", 1).try_cast("long"))
    met = pieces.join(have, ["qid", "number"], "left").withColumn("piece", F.coalesce("said", "piece"))
    return met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x.piece), "").alias("answer"))


def verified(answers: DataFrame, records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, sentence_no, sentence, verdict): whether the evidence holds the names and words of each sentence of more than ten characters.

    A sentence is held against the records it cites, or else all of its question: by the words they use.
    """
    numbered = records.select("qid", F.regexp_extract("id", r"(\d+)", 1).try_cast("long").alias("number"), F.lower("content").alias("content"))
    words = numbered.select("qid", "number", F.explode(F.array_distinct(F.array_remove(F.split("content", "[^a-z]+"), ""))).alias("word")).distinct()
    pieces = answers.select(F.col(key), "qid", F.posexplode(F.filter(F.transform(F.split("answer", r"[.\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)).alias("sentence_no", "sentence"))
    pieces = pieces.withColumn("cites", F.transform(F.regexp_extract_all("sentence", F.lit(r"EVIDENCE_(\d+)")), lambda n: n.cast("long")))
    content = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("sentence"), F.lit(r"([a-z]{4,})")), lambda w: ~w.isin(SMALL) & ~w.startswith("evidence")))
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("sentence", F.lit(r"([A-Z][a-z]+)")), lambda w: F.lower(w)), lambda w: ~w.isin(CONNECTORS)))
    pieces = pieces.withColumn("content", content).withColumn("names", names)
    asked = pieces.select(key, "qid", "sentence_no", "cites", F.explode(F.array_union("content", "names")).alias("word"))
    found = asked.join(words, ["qid", "word"]).filter((F.size("cites") == 0) | F.array_contains("cites", F.col("number"))).groupBy(key, "sentence_no").agg(F.collect_set("word").alias("found"))
    rows = pieces.join(found, [key, "sentence_no"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    hit, missing = F.size(F.array_intersect("content", "found")), F.size(F.array_except("names", "found"))
    verdict = F.when((F.size("content") > 0) & (hit == 0) & (missing > 0), "unsupported").when((missing > 0) & (hit < 2), "partially_supported").otherwise("supported")
    return rows.select(key, (F.col("sentence_no") + 1).alias("sentence_no"), "sentence", verdict.alias("verdict"))


# Words that say that sources disagree, and the phrase of an honest refusal.
ACKNOWLEDGED = [
    "conflict", "disagree", "contradict", "allegation", "alleged", "claimed", "however", "whereas", "on the other hand", "alternatively", "disputed", "contrasting", "unclear", "divergent", "differing", "while", "accused",
]
REFUSAL = "insufficient information to answer"


def judged(answers: DataFrame, records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, issues, unsupported, disputed, acknowledged, is_verified): whether each answer holds: no faulty citation, no unsupported
    sentence, and conflicting evidence acknowledged. A refusal holds. Null answers have no faults to find."""
    rows = answers.select(F.col(key), "qid", F.lower(F.coalesce("answer", F.lit(""))).alias("said"))
    issues = citation_issues(answers, records, key).groupBy(key).agg(F.count("*").alias("issues"))
    weak = verified(answers, records, key).filter("verdict = 'unsupported'").groupBy(key).agg(F.count("*").alias("unsupported"))
    disputed = conflicts(records).select("qid").distinct().withColumn("disputed", F.lit(True))
    rows = rows.join(issues, key, "left").join(weak, key, "left").join(disputed, "qid", "left")
    rows = rows.select(key, F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("unsupported", F.lit(0)).alias("unsupported"), F.coalesce("disputed", F.lit(False)).alias("disputed"), F.exists(F.array(*[F.lit(w) for w in ACKNOWLEDGED]), lambda w: F.contains(F.col("said"), w)).alias("acknowledged"), F.contains("said", F.lit(REFUSAL)).alias("refuses"))
    held = (F.col("issues") == 0) & (F.col("unsupported") == 0) & (~F.col("disputed") | F.col("acknowledged"))
    return rows.withColumn("is_verified", F.col("refuses") | held).drop("refuses")


def citation_details(answers: DataFrame, records: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, number, record_id, document_title, place, excerpt): the records that answers cite, once each, with 200 characters of them."""
    have = records.select("qid", F.regexp_extract("id", r"(\d+)", 1).try_cast("long").alias("number"), "record_id", F.coalesce("document_title", F.lit("Archive Document")).alias("document_title"), place_of(F.col("page"), F.col("metadata")).alias("place"), F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content")).alias("excerpt"))
    return cited(answers, key).select(key, "qid", "number").distinct().join(have, ["qid", "number"]).drop("qid")
