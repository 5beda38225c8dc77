"""The registered queries of the core over an archive's tables, each with the same question in SQL where SQL can put it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import text as T
from archivolt.operators import chunking, entities, evidence, graph, metrics, naming, questions, retrieval
from archivolt.plans import answering
from archivolt.plans.session import cut
from archivolt.sources import files
from archivolt.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (of session and folder) under a name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(qid, question): every question once."""
    return table(spark, d, "hybrid_results").filter("qid is not null and question is not null").groupBy("qid").agg(F.min("question").alias("question"))


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Evidence once each, with the columns that are asked for (all, if none is): what isn't needed is not shuffled."""
    rows = table(spark, d, "evidence_records")
    return evidence.once(rows.select("record_id", "registered_at", *columns) if columns else rows)


# Fragments of SQL that several queries begin with.
_ONCE = "once AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY (registered_at IS NULL), registered_at) AS n FROM evidence_records) WHERE n = 1)"
_ASKED = "asked AS (SELECT qid, min(question) AS question FROM hybrid_results WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TERMS = f"terms AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS term FROM asked) WHERE NOT list_contains({_STOP}, term) AND length(term) > 2)"
_BM25 = f"""{_ASKED}, {_ONCE}, {_TERMS},
    said AS (SELECT record_id AS chunk, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM once WHERE content IS NOT NULL),
    sized AS (SELECT chunk, w, len(w) AS length FROM said WHERE len(w) > 0),
    counts AS (SELECT term, chunk, length, count(*) AS tf FROM (SELECT chunk, length, unnest(w) AS term FROM sized) GROUP BY ALL),
    whole AS (SELECT count(*) AS texts, avg(length) AS mean FROM sized),
    dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
    lexical AS (SELECT qid, chunk, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) AS rank FROM (
        SELECT qid, chunk, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM counts JOIN dfs USING (term) JOIN terms USING (term), whole GROUP BY qid, chunk)) WHERE rank <= 50)"""
MOST = answering.MOST_WORDS
_GAZETTE = f"""gazette AS (SELECT said, min(name) AS entity, len(string_split(said, ' ')) AS size FROM (SELECT name, array_to_string(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), ' ') AS said
        FROM (SELECT title AS name FROM documents UNION SELECT name FROM entities UNION SELECT unnest(aliases) FROM entities) WHERE name IS NOT NULL) WHERE len(string_split(said, ' ')) BETWEEN 2 AND {MOST} GROUP BY said)"""


def _matched(key: str, text: str, source: str) -> str:
    """(key, entity, n): the names of the gazette in texts; of those that overlap the longest, then the first."""
    return f"""(SELECT key, m.entity AS entity, count(*) AS n FROM (SELECT key, unnest(list_reduce(list_transform(spans, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.spot < x[1].spot + x[1].size AND x[1].spot < y.spot + y.size)) > 0 THEN a ELSE list_concat(a, x) END)) AS m
        FROM (SELECT key, list(struct_pack(spot := spot, size := size, entity := entity) ORDER BY size DESC, spot, entity) AS spans FROM (SELECT key, spot, array_to_string(w[spot:spot + g - 1], ' ') AS said
            FROM (SELECT key, w, g, unnest(range(1, len(w) - g + 2)) AS spot FROM (SELECT {key} AS key, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE {text} IS NOT NULL), unnest(range(1, {MOST + 1})) AS r(g) WHERE len(w) >= g)) JOIN gazette USING (said) GROUP BY key)) GROUP BY ALL)"""


_ENTITY = f"""{_GAZETTE},
    mentioned AS (SELECT key AS chunk, entity FROM {_matched("record_id", "content", "once")}),
    named AS (SELECT key AS qid, entity FROM {_matched("qid", "question", "asked")}),
    raw_ AS (SELECT qid, chunk, round(count(*) * (1 + 0.5 * (count(DISTINCT entity) - 1)), 4) AS raw FROM named JOIN mentioned USING (entity) GROUP BY qid, chunk),
    entity_list AS (SELECT qid, chunk, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) AS rank FROM (
        SELECT qid, chunk, round(raw / max(raw) OVER (PARTITION BY qid), 4) AS score FROM raw_)) WHERE rank <= 50)"""


def _vectors(name: str, key: str, text: str, source: str) -> str:
    """The offline vectors of texts, one row per cell that isn't zero."""
    return f"""{name} AS (SELECT key, cell, v, sqrt(sum(v * v) OVER (PARTITION BY key)) AS n FROM (SELECT key, h % 64 AS cell, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT key, ('0x' || md5(g)[1:8])::BIGINT AS h FROM (
        SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM (SELECT {key} AS key, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}))) GROUP BY ALL))"""


def _nearest(name: str, of: str) -> str:
    return f"""{name} AS (SELECT qid, chunk, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) AS rank FROM (
        SELECT q.key AS qid, x.key AS chunk, round(sum(q.v * x.v) / any_value(q.n * x.n), 6) AS score FROM asked_cells q JOIN {of} x USING (cell) GROUP BY q.key, x.key)) WHERE rank <= 50)"""


_SAID = "(SELECT * FROM once WHERE trim(content) <> '')"
_DENSE = f"""{_vectors("asked_cells", "qid", "question", "asked")}, {_vectors("text_cells", "record_id", "content", _SAID)}, {_nearest("dense_list", "text_cells")}"""
_CONTEXTUAL = f"""{_vectors("context_cells", "record_id", "concat_ws(' ', document_title, section_title, content)", _SAID)}, {_nearest("contextual_list", "context_cells")}"""


# --- sources, sinks

@query("s1_discover", """
    SELECT path, category, format, is_scan, regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '\\.scan$', '') AS stem FROM (
        SELECT DISTINCT file_path AS path, list_extract(string_split(file_path, '/'), -1) AS name, lower(regexp_extract(list_extract(string_split(file_path, '/'), -1), '\\.([^.]+)$', 1)) AS format,
            CASE WHEN format IN ('png', 'jpg', 'jpeg') THEN 'images' WHEN string_split(file_path, '/')[1] IN ('chronicles', 'wiki', 'codex', 'ephemera') THEN string_split(file_path, '/')[1] ELSE 'ephemera' END AS category,
            contains(name, '.scan.') AS is_scan FROM (SELECT file_path FROM page_contents) WHERE file_path IS NOT NULL)
    WHERE name NOT IN ('README.txt', 'sample_questions.json', '.DS_Store') AND name NOT LIKE '.%'""".replace("format IN", "lower(regexp_extract(list_extract(string_split(file_path, '/'), -1), '\\.([^.]+)$', 1)) IN").replace("contains(name,", "contains(list_extract(string_split(file_path, '/'), -1),"))
def s1_discover(spark, d):
    return files.discovered(table(spark, d, "page_contents"))


@query("s2_bundle", """
    WITH f AS (SELECT DISTINCT file_path AS path, list_extract(string_split(file_path, '/'), -1) AS name FROM page_contents WHERE file_path IS NOT NULL),
    g AS (SELECT path, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS format, CASE WHEN string_split(path, '/')[1] IN ('chronicles', 'wiki', 'codex', 'ephemera') THEN string_split(path, '/')[1] ELSE 'ephemera' END AS category,
        regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '\\.scan$', '') AS stem FROM f)
    SELECT category, stem, arg_min(path, (CASE WHEN format IN ('docx', 'md') THEN 0 ELSE 1 END, path)) AS primary_path, count(*) AS representation_count, array_to_string(list_sort(list(DISTINCT format)), ',') AS formats
    FROM g WHERE format IN ('pdf', 'docx', 'md', 'txt') GROUP BY category, stem""")
def s2_bundle(spark, d):
    return files.bundled(files.discovered(table(spark, d, "page_contents"))).drop("title")


@query("s5_sections", """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, regexp_matches(line, '^#{1,6}\\s') AS heading FROM l),
    n AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY spot) AS section_no FROM h)
    SELECT doc_id, section_no, length(content) AS size FROM (SELECT doc_id, section_no, trim(coalesce(string_agg(CASE WHEN NOT heading THEN line END, chr(10) ORDER BY spot), '')) AS content FROM n GROUP BY doc_id, section_no) WHERE content <> ''""")
def s5_sections(spark, d):
    return files.markdown_sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section_no", F.length("content").cast("long").alias("size"))


@query("s13_first_by_name", "SELECT list_extract(string_split(file_path, '/'), -1) AS name, min(file_path) AS path FROM page_contents WHERE file_path IS NOT NULL GROUP BY ALL")
def s13_first_by_name(spark, d):
    return files.first_by_name(table(spark, d, "page_contents"))


@query("k1_upsert", "SELECT record_id, qid, document_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY registered_at DESC NULLS LAST) AS n FROM evidence_records) WHERE n = 1")
def k1_upsert(spark, d):
    """Of each record the delivery registered last; a score that is no number is null."""
    rows = table(spark, d, "evidence_records").withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    best = rows.groupBy("record_id").agg(F.max_by(F.struct("qid", "document_id", "score"), F.coalesce("registered_at", F.lit("1900-01-01").cast("timestamp"))).alias("r"))
    return best.select("record_id", "r.*")


@query("k7_cache_misses", "SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT text_hash FROM embedding_cache WHERE text_hash IS NOT NULL)")
def k7_cache_misses(spark, d):
    """Texts that the cache of vectors doesn't have."""
    texts = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return texts.join(table(spark, d, "embedding_cache").select("text_hash"), "text_hash", "left_anti").select("doc_id", "text_hash")


@query("k9_resume", "SELECT DISTINCT qid FROM hybrid_results WHERE qid IS NOT NULL AND qid NOT IN (SELECT qid FROM hybrid_results WHERE experiment = 'E5_rerank' AND qid IS NOT NULL)")
def k9_resume(spark, d):
    """Questions that an experiment hasn't answered yet."""
    rows = table(spark, d, "hybrid_results").filter("qid is not null")
    return rows.select("qid").distinct().join(rows.filter("experiment = 'E5_rerank'").select("qid"), "qid", "left_anti")


@query("k10_repeated_keys", "SELECT record_id, count(*) AS n FROM evidence_records GROUP BY record_id HAVING count(*) > 1")
def k10_repeated_keys(spark, d):
    return table(spark, d, "evidence_records").groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1")


# --- chunking

@query("t1_token_count", "SELECT doc_id, greatest(1, floor(len(regexp_extract_all(text, '\\S+')) * 1.3))::INT AS tokens FROM documents WHERE text IS NOT NULL")
def t1_token_count(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("t2_chunks")
def t2_chunks(spark, d):
    return chunking.chunks(table(spark, d, "documents"), most=512, overlap=100)


@query("t5_prefixes", f"""
    WITH {_ONCE}, m AS (SELECT chunk_id, list(DISTINCT trim(name) || ' [' || upper(coalesce(entity_type, 'unknown')[1]) || lower(coalesce(entity_type, 'unknown')[2:]) || ']') AS said FROM extracted_entities WHERE name IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
    p AS (SELECT record_id, 'From ' || nullif(trim(document_title), '') AS a, 'Section: ' || nullif(trim(section_title), '') AS b, list_sort(said) AS said FROM once LEFT JOIN m USING (chunk_id))
    SELECT record_id, trim(concat_ws(', ', a, b) || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE '.' END || CASE WHEN said IS NULL THEN '' ELSE ' Entities: ' || array_to_string(said, ', ') || '.' END) AS prefix FROM p""")
def t5_prefixes(spark, d):
    said = table(spark, d, "extracted_entities").filter("name is not null and chunk_id is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct(F.trim("name").alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("type")))).alias("names"))
    rows = records(spark, d, "chunk_id", "document_title", "section_title").join(said, "chunk_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<name:string,type:string>>")))
    return chunking.prefixes(rows, "document_title", "section_title", "names").select("record_id", "prefix")


@query("t6_needs_context", f"WITH {_ONCE}, m AS (SELECT chunk_id, count(DISTINCT name) AS n FROM extracted_entities GROUP BY chunk_id) SELECT record_id FROM once LEFT JOIN m USING (chunk_id) WHERE length(content) >= 30 AND coalesce(n, 0) <= 1 AND len(regexp_extract_all(content, '(?i)\\b(he|she|they|it|his|her|their|him|them)\\b')) >= 2")
def t6_needs_context(spark, d):
    named = table(spark, d, "extracted_entities").groupBy("chunk_id").agg(F.count_distinct("name").alias("n"))
    rows = records(spark, d, "chunk_id", "content").join(named, "chunk_id", "left")
    return rows.filter(chunking.needs_context(F.col("content"), F.coalesce("n", F.lit(0)))).select("record_id")


@query("t7_neighbours", "SELECT page_id, lag(page_id) OVER w AS previous, lead(page_id) OVER w AS following FROM page_contents WHERE file_path IS NOT NULL WINDOW w AS (PARTITION BY file_path ORDER BY page_number NULLS FIRST, page_id)")
def t7_neighbours(spark, d):
    return chunking.neighbours(table(spark, d, "page_contents").filter("file_path is not null"), "file_path", ["page_number", "page_id"], "page_id").select("page_id", "previous", "following")


@query("t9_archive_report", """
    SELECT source_category, count(*) AS documents, count(*) FILTER (WHERE id NOT IN (SELECT document_id FROM page_contents WHERE document_id IS NOT NULL)) AS without_pages, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS empty,
        count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') - count(DISTINCT CASE WHEN trim(coalesce(text, '')) <> '' THEN substring(trim(text), 1, 100) END) AS repeated FROM documents GROUP BY source_category""")
def t9_archive_report(spark, d):
    return chunking.archive_report(table(spark, d, "documents"), table(spark, d, "page_contents"))


@query("t10_locations", f"""
    WITH r AS (SELECT DISTINCT record_id, document_id AS id, lower(substring(trim(content), 1, 45)) AS snippet FROM evidence_records WHERE trim(content) <> ''), t AS (SELECT id, regexp_replace(lower(text), '[ ]+', ' ', 'g') AS text FROM documents),
    f AS (SELECT record_id, snippet, text, instr(text, snippet) AS spot FROM r JOIN t USING (id))
    SELECT record_id, CASE WHEN spot > 0 THEN len(regexp_split_to_array(substring(text, 1, spot - 1), '\\n\\n+')) END AS paragraph, CASE WHEN spot > 0 THEN len(string_split(substring(text, 1, spot - 1), chr(10))) END AS line FROM f""")
def t10_locations(spark, d):
    return chunking.locations(table(spark, d, "evidence_records"), table(spark, d, "documents"))


# --- entities and graph

def gazette(spark: SparkSession, d: str) -> DataFrame:
    """Names that are looked up in texts: documents' titles, and the names and aliases of entities, of at least two words."""
    known = table(spark, d, "entities")
    names = table(spark, d, "documents").select(F.col("title").alias("name")).unionByName(known.select("name")).unionByName(known.select(F.explode("aliases").alias("name")))
    return names.filter(F.size(T.tokens(F.col("name"))) >= 2).distinct()


@query("e2_gazette", f"WITH {_ONCE}, {_GAZETTE} SELECT key AS record_id, entity AS name, n FROM {_matched('record_id', 'content', 'once')}")
def e2_gazette(spark, d):
    return entities.gazette_matches(records(spark, d, "content"), gazette(spark, d), "record_id", "content", MOST)


@query("e4_capitalised", f"WITH {_ONCE} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(content, '[ \\n]+')) AS word FROM once) WHERE regexp_full_match(word, '[A-Z][a-z]+') GROUP BY word")
def e4_capitalised(spark, d):
    return entities.capitalised(records(spark, d, "content"), "content")


@query("e8_core_names", "SELECT entity_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '(?i)^(ser|lord|lady|high|the)\\s+', ''), '(?i)\\s+the\\s+\\S+$', ''), '(?i)\\s+of\\s+(the\\s+)?\\S+(\\s+\\S+)?$', '')) AS core FROM entities WHERE name IS NOT NULL")
def e8_core_names(spark, d):
    return table(spark, d, "entities").filter("name is not null").select("entity_id", T.core_name(F.col("name")).alias("core"))


_ID = """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[(('0x' || h[17])::INT % 4) + 1] || h[18:20] || '-' || h[21:32] FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('ashen_era:entity:' || lower(trim(name)))) AS h))"""
_NAMED = f"named AS (SELECT DISTINCT ON (mention_id) *, {_ID} AS id FROM extracted_entities WHERE name IS NOT NULL AND trim(name) <> '')"


@query("e10_entity_ids", f"SELECT DISTINCT name, {_ID} AS id FROM extracted_entities WHERE name IS NOT NULL AND trim(name) <> ''")
def e10_entity_ids(spark, d):
    return entities.distinct_mentions(table(spark, d, "extracted_entities")).select("name", "id").distinct()


@query("e11_entities", f"""
    WITH {_NAMED}, r AS (SELECT *, CASE source WHEN 'gazette' THEN 3 WHEN 'gemini_ner' THEN 2 WHEN 'rules' THEN 1 ELSE 0 END AS rank FROM named),
    a AS (SELECT id, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM (SELECT id, unnest(mentions) AS alias FROM r) WHERE alias IS NOT NULL GROUP BY id)
    SELECT id, arg_min(name, (-rank, mention_id)) AS name, coalesce(arg_min(entity_type, (-rank, mention_id)) FILTER (WHERE coalesce(entity_type, 'UNKNOWN') <> 'UNKNOWN'), 'UNKNOWN') AS entity_type, first(source ORDER BY rank DESC, mention_id) AS source,
        max(confidence) AS confidence, count(*) AS mention_count, count(DISTINCT chunk_id) AS chunks, coalesce(any_value(aliases), '') AS aliases FROM r LEFT JOIN a USING (id) GROUP BY id""")
def e11_entities(spark, d):
    return entities.aggregated(table(spark, d, "extracted_entities"))


@query("e12_links", f"WITH {_NAMED} SELECT DISTINCT id, chunk_id, document_id FROM named WHERE chunk_id IS NOT NULL")
def e12_links(spark, d):
    return entities.links(table(spark, d, "extracted_entities"))


@query("e13_aliases", """
    WITH t AS (SELECT trim(unnest(mentions)) AS alias, lower(trim(name)) AS said FROM extracted_entities WHERE name IS NOT NULL), m AS (SELECT said, list_sort(list(DISTINCT alias)) AS more FROM t WHERE alias <> '' AND said <> '' GROUP BY said)
    SELECT entity_id, name, len(list_distinct(list_concat(coalesce(aliases, []), coalesce(more, [])))) AS aliases FROM (SELECT *, lower(trim(name)) AS said FROM entities) LEFT JOIN m USING (said)""")
def e13_aliases(spark, d):
    said = table(spark, d, "extracted_entities").select(F.explode("mentions").alias("alias"), F.col("name").alias("canonical"))
    return entities.with_aliases(table(spark, d, "entities"), said).withColumn("aliases", F.size("aliases").cast("long"))


@query("r7_cooccurrence", f"WITH {_NAMED}, c AS (SELECT DISTINCT chunk_id, id FROM named WHERE chunk_id IS NOT NULL) SELECT x.id AS a, y.id AS b, count(*) AS weight, array_to_string(list_sort(list(chunk_id))[1:20], ',') AS chunk_ids FROM c x JOIN c y USING (chunk_id) WHERE x.id < y.id GROUP BY x.id, y.id")
def r7_cooccurrence(spark, d):
    return graph.cooccurrence(table(spark, d, "extracted_entities"))


@query("r5_relations", """
    WITH r AS (SELECT c_name AS source, n_name AS target, 'LOCATED_IN' AS relation, 1.0::DOUBLE AS confidence, c_custkey AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_name, n_name, 'LOCATED_IN', 0.5, c_custkey + 1000000 FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT source, target, relation, confidence, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target), relation ORDER BY seq) AS n FROM r WHERE lower(source) <> lower(target)) WHERE n = 1""")
def r5_relations(spark, d):
    one = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("LOCATED_IN").alias("relation"), F.lit(1.0).alias("confidence"), F.col("c_custkey").alias("seq"))
    return graph.deduplicated(one.unionByName(one.withColumn("confidence", F.lit(0.5)).withColumn("seq", F.col("seq") + 1000000)))


@query("r8_find_entity", """
    WITH f AS (SELECT entity_id, coalesce(mention_count, 0) AS m, lower(name) AS said, 1 AS exact FROM entities UNION ALL SELECT entity_id, coalesce(mention_count, 0), lower(unnest(aliases)), 0 FROM entities),
    b AS (SELECT said, first(entity_id ORDER BY exact DESC, m DESC, entity_id) AS entity_id, max(exact) = 1 AS exact FROM f WHERE said IS NOT NULL GROUP BY said)
    SELECT asked, entity_id, exact FROM (SELECT DISTINCT name AS asked FROM extracted_entities WHERE name IS NOT NULL) JOIN b ON lower(asked) = said""")
def r8_find_entity(spark, d):
    return entities.looked_up(table(spark, d, "extracted_entities"), table(spark, d, "entities"))


@query("r12_statistics", "SELECT coalesce(entity_type, 'UNKNOWN') AS entity_type, count(*) AS n, sum(coalesce(mention_count, 0))::BIGINT AS mentions FROM entities GROUP BY ALL")
def r12_statistics(spark, d):
    return table(spark, d, "entities").groupBy(F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type")).agg(F.count("*").alias("n"), F.sum(F.coalesce("mention_count", F.lit(0))).alias("mentions"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a graph: nations in regions, suppliers and customers in nations."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("dst"))
    customer = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst"))
    return nation.unionByName(supplier).unionByName(customer).withColumn("edge", F.concat_ws("-", "src", "dst"))


_EDGES = """edges AS (SELECT src || '-' || dst AS edge, src, dst FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)),
    both_ AS (SELECT edge, src AS a, dst AS b FROM edges UNION ALL SELECT edge, dst, src FROM edges)"""


@query("r11_related", f"WITH {_EDGES} SELECT DISTINCT a AS node, b AS neighbour FROM both_ WHERE a LIKE 'n%'")
def r11_related(spark, d):
    return graph.related(_places(spark, d), table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node")))


@query("r13_trails", f"""
    WITH RECURSIVE {_EDGES}, t(seed, node, hops, path, used) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0, 'r' || r_regionkey, []::VARCHAR[] FROM region UNION ALL SELECT seed, b, hops + 1, path || ' > ' || b, list_append(used, edge) FROM t JOIN both_ ON node = a WHERE hops < 2 AND NOT list_contains(used, edge))
    SELECT seed, node, hops, path FROM t WHERE seed <> node""")
def r13_trails(spark, d):
    return graph.trails(_places(spark, d), table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node")), 2)


@query("r14_reached", f"""
    WITH RECURSIVE {_EDGES}, t(seed, node, hops, path, used) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0, 'r' || r_regionkey, []::VARCHAR[] FROM region UNION ALL SELECT seed, b, hops + 1, path || ' > ' || b, list_append(used, edge) FROM t JOIN both_ ON node = a WHERE hops < 2 AND NOT list_contains(used, edge))
    SELECT seed, node, min(hops) AS hops, count(DISTINCT path) AS paths FROM t WHERE seed <> node GROUP BY seed, node""")
def r14_reached(spark, d):
    return graph.reached(r13_trails(spark, d))


@query("r15_hydrated", f"""
    WITH c AS (SELECT chunk_id, arg_min(content, record_id) AS content, arg_min(struct_pack(d := document_id), record_id).d AS document_id FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
    q AS (SELECT DISTINCT unnest(retrieved_chunk_ids) AS chunk_id FROM hybrid_results)
    SELECT chunk_id, content, coalesce(title, 'Visual Archive Asset') AS document_title, coalesce(source_category, 'images') AS source_category FROM q JOIN c USING (chunk_id) LEFT JOIN documents ON documents.id = document_id""")
def r15_hydrated(spark, d):
    ids = table(spark, d, "hybrid_results").select(F.explode("retrieved_chunk_ids").alias("chunk_id"))
    return graph.hydrated(ids, table(spark, d, "evidence_records").filter("chunk_id is not null"), table(spark, d, "documents"))


# --- questions

@query("q1_names")
def q1_names(spark, d):
    return asked(spark, d).select("qid", F.array_join(questions.names(F.col("question")), "|").alias("names"))


@query("q2_lexical_query")
def q2_lexical_query(spark, d):
    return asked(spark, d).select("qid", questions.lexical_query(F.col("question"), questions.names(F.col("question"))).alias("query"))


@query("q3_composed")
def q3_composed(spark, d):
    return asked(spark, d).select("qid", questions.kind(F.col("question"), questions.names(F.col("question"))).alias("kind"))


@query("q4_sub_questions")
def q4_sub_questions(spark, d):
    return asked(spark, d).select("qid", F.posexplode(questions.sub_questions(F.col("question"))).alias("no", "question"))


@query("q5_analysis")
def q5_analysis(spark, d):
    found = questions.names(F.col("question"))
    kind = questions.kind(F.col("question"), found)
    return asked(spark, d).select("qid", kind.alias("kind"), F.size(found).alias("names"), questions.lexical_query(F.col("question"), found).alias("query"), F.when(kind == "multi_hop", F.array_join(questions.sub_questions(F.col("question")), "|")).otherwise("").alias("sub_questions"))


# --- retrieval

@query("v1_bm25", f"WITH {_BM25} SELECT qid, chunk, score, rank FROM lexical")
def v1_bm25(spark, d):
    return retrieval.bm25(asked(spark, d), records(spark, d, "content").filter("content is not null"), "record_id", "content").select("qid", "chunk", "score", "rank")


@query("v1_cover_density")
def v1_cover_density(spark, d):
    """Records that hold all words of the names in a question."""
    named = asked(spark, d).select("qid", F.array_join(questions.names(F.col("question")), " ").alias("question"))
    return retrieval.cover_density(named, records(spark, d, "content"), "record_id", "content").select("qid", "chunk", "score", "rank")


_USABLE = "usable AS (SELECT vec_id AS id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM embedding_cache WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"


@query("v2_dense", f"""
    WITH {_USABLE}, s AS (SELECT q.id AS qid, x.id AS chunk, round(list_cosine_similarity(q.v, x.v), 6) AS score FROM usable q, usable x WHERE q.id % 20 = 0)
    SELECT qid, chunk, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) AS rank FROM s) WHERE rank <= 5""")
def v2_dense(spark, d):
    """The stated set of queries: every vector whose id is divisible by 20, against all."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, d, "embedding_cache").filter((F.size("vector") == 64) & ~odd & F.exists("vector", lambda x: x != 0)).select(F.col("vec_id").alias("id"), "vector")
    return retrieval.dense(rows.filter("id % 20 = 0"), rows, 5).select("qid", "chunk", "score", "rank")


@query("v2_text_dense", f"WITH {_ASKED}, {_ONCE}, {_DENSE} SELECT qid, chunk, score, rank FROM dense_list")
def v2_text_dense(spark, d):
    """Records by the vectors of their texts: questions as the stated set of queries."""
    return answering.by_vector(asked(spark, d), answering.vectors(records(spark, d, "content")), 50).select("qid", "chunk", "score", "rank")


@query("v2_contextual", f"WITH {_ASKED}, {_ONCE}, {_vectors('asked_cells', 'qid', 'question', 'asked')}, {_CONTEXTUAL} SELECT qid, chunk, score, rank FROM contextual_list")
def v2_contextual(spark, d):
    """Records by the vectors of their texts with the titles they stand under."""
    known = answering.vectors(records(spark, d, "content", "document_title", "section_title"), contextual=True)
    return answering.by_vector(asked(spark, d), known, 50).select("qid", "chunk", "score", "rank")


def _archive(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with what retrieval reads of it, made unique once for all streams."""
    return cut(records(spark, d, "content", "document_id", "document_title", "section_title", "source_category"))


@query("v3_entity_search", f"WITH {_ASKED}, {_ONCE}, {_ENTITY} SELECT qid, chunk, score, rank FROM entity_list")
def v3_entity_search(spark, d):
    only = answering.Config(lexical=False, dense=False, contextual=False)
    rows, names = records(spark, d, "content"), gazette(spark, d)
    return answering.streams(asked(spark, d), rows, names, answering.mentioned(rows, names), only)[0].select("qid", "chunk", "score", "rank")


_FUSED = """every_ AS (SELECT qid, chunk, rank, 0 AS stream FROM lexical UNION ALL SELECT qid, chunk, rank, 1 FROM dense_list UNION ALL SELECT qid, chunk, rank, 2 FROM contextual_list UNION ALL SELECT qid, chunk, rank, 3 FROM entity_list),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_.stream, first_.rank, chunk) AS rank FROM (SELECT qid, chunk, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS streams, min(struct_pack(stream := stream, rank := rank)) AS first_ FROM every_ GROUP BY qid, chunk)) WHERE rank <= 100)"""
_STREAMS = f"{_BM25}, {_DENSE}, {_CONTEXTUAL}, {_ENTITY}, {_FUSED}"


def _fused(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    rows, names = rows.filter("content is not null"), gazette(spark, d)
    return retrieval.fused(answering.streams(asked(spark, d), rows, names, answering.mentioned(rows, names), answering.Config()))


@query("v4_rrf", f"WITH {_STREAMS} SELECT qid, chunk, score, rank, streams FROM fused")
def v4_rrf(spark, d):
    """The lexical, dense, contextual and entity streams of 50 each, fused."""
    return _fused(spark, d, _archive(spark, d))


_DIVERSE = """diverse AS (SELECT qid, chunk, CASE WHEN n > 20 THEN row_number() OVER (PARTITION BY qid ORDER BY (NOT kept)::INT, rank) ELSE rank END AS rank FROM (SELECT f.qid, f.chunk, f.rank, count(*) OVER (PARTITION BY f.qid) AS n,
        f.rank <= 3 OR row_number() OVER (PARTITION BY f.qid, coalesce(document_id, document_title, 'unknown') ORDER BY f.rank) <= 3 AS kept FROM fused f JOIN once ON record_id = chunk))"""


@query("v5_diversity", f"WITH {_STREAMS}, {_DIVERSE} SELECT qid, chunk, rank FROM diverse")
def v5_diversity(spark, d):
    rows = _archive(spark, d)
    about = rows.select(F.col("record_id").alias("chunk"), F.coalesce("document_id", "document_title", F.lit("unknown")).alias("document"))
    return answering.diversified(_fused(spark, d, rows).join(about, "chunk"), answering.Config()).select("qid", "chunk", "rank")


@query("v8_hybrid", f"""
    WITH {_STREAMS}, {_DIVERSE}, size_ AS (SELECT qid, count(*) AS n FROM terms GROUP BY qid), hit AS (SELECT d.qid, d.chunk, d.rank, count(c.term) AS n FROM diverse d LEFT JOIN terms t ON t.qid = d.qid LEFT JOIN counts c ON c.term = t.term AND c.chunk = d.chunk WHERE d.rank <= 30 GROUP BY ALL)
    SELECT qid, chunk, score, rank, before FROM (SELECT qid, chunk, score, before, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM (SELECT hit.qid, chunk, hit.rank AS before, round(hit.n / greatest(coalesce(size_.n, 0), 1), 6) AS score FROM hit LEFT JOIN size_ USING (qid))) WHERE rank <= 20""")
def v8_hybrid(spark, d):
    """Hybrid retrieval at its full depth: 50 of each of the lexical, dense, contextual and entity streams, the first 100 fused, 30 reranked, 20 kept."""
    return answering.retrieved(asked(spark, d), _archive(spark, d), gazette(spark, d))


@query("v10_interleaved", f"""
    WITH {_BM25}, {_ENTITY}, i AS (SELECT qid, chunk, min(struct_pack(rank := rank, stream := stream)) AS first_ FROM (SELECT qid, chunk, rank, 0 AS stream FROM lexical UNION ALL SELECT qid, chunk, rank, 1 FROM entity_list) GROUP BY qid, chunk)
    SELECT qid, chunk, rank FROM (SELECT qid, chunk, row_number() OVER (PARTITION BY qid ORDER BY first_.rank, first_.stream) AS rank FROM i) WHERE rank <= 40""")
def v10_interleaved(spark, d):
    rows, names = cut(records(spark, d, "content").filter("content is not null")), gazette(spark, d)
    only = answering.Config(dense=False, contextual=False)
    return retrieval.interleaved(*answering.streams(asked(spark, d), rows, names, answering.mentioned(rows, names), only, {}), 40)


@query("v9_multi_hop")
def v9_multi_hop(spark, d):
    return answering.multi_hop(asked(spark, d), _archive(spark, d), gazette(spark, d))


@query("v6_reranked")
def v6_reranked(spark, d):
    """All of a question's registered evidence by the offline scorer."""
    ranked = evidence.registered(records(spark, d)).filter("content is not null").select("qid", F.col("record_id").alias("chunk"), F.col("seq").alias("rank"))
    return retrieval.reranked(ranked, asked(spark, d), records(spark, d), "record_id", "content", 30, 20)


# --- evidence

@query("x18_answers")
def x18_answers(spark, d):
    return answering.answers(asked(spark, d), records(spark, d), gazette(spark, d))


@query("x1_sources")
def x1_sources(spark, d):
    rows = table(spark, d, "evidence_records").select("source_file", "source_category").distinct()
    return rows.withColumn("t", evidence.traits(F.coalesce("source_file", F.lit("")), F.col("source_category"))).select("source_file", "source_category", "t.*")


_SEQ = f"{_ONCE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, record_id) AS seq FROM once)"


@query("x2_registered", f"WITH {_SEQ} SELECT record_id, qid, format('EVIDENCE_{{:03d}}', seq) AS evidence_id FROM numbered")
def x2_registered(spark, d):
    return evidence.registered(records(spark, d, "qid", "score")).select("record_id", "qid", "evidence_id")


@query("x3_first_of_chunk", f"WITH {_SEQ} SELECT record_id, qid, seq FROM (SELECT *, row_number() OVER (PARTITION BY qid, coalesce(chunk_id, '#' || record_id) ORDER BY seq) AS n FROM numbered) WHERE n = 1")
def x3_first_of_chunk(spark, d):
    return evidence.first_of_chunk(evidence.registered(records(spark, d, "qid", "score", "chunk_id"))).select("record_id", "qid", "seq")


@query("x4_diversity", f"WITH {_ONCE} SELECT qid, count(*) AS total, count(DISTINCT coalesce(document_title, document_id)) AS documents, count(DISTINCT source_category) AS categories, count(DISTINCT source_subtype) AS subtypes FROM once GROUP BY qid")
def x4_diversity(spark, d):
    return evidence.diversity(records(spark, d, "qid", "document_title", "document_id", "source_category", "source_subtype"))


@query("x5_cited_records", f"""
    WITH {_ONCE}, c AS (SELECT result_id, qid, unnest(regexp_extract_all(answer, 'EVIDENCE_(\\d+)', 1))::BIGINT AS number FROM hybrid_results), r AS (SELECT qid, regexp_extract(id, '(\\d+)', 1)::BIGINT AS number, record_id FROM once)
    SELECT DISTINCT result_id, number, record_id FROM c JOIN r USING (qid, number)""")
def x5_cited_records(spark, d):
    have = records(spark, d, "qid", "id").select("qid", F.regexp_extract("id", r"(\d+)", 1).try_cast("long").alias("number"), "record_id")
    return evidence.cited(table(spark, d, "hybrid_results")).join(have, ["qid", "number"]).select("result_id", "number", "record_id").distinct()


@query("x7_sufficiency", f"""
    WITH {_ASKED}, {_SEQ}, a AS (SELECT qid, list_filter(regexp_extract_all(question, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda w: length(w) > 2) AS big, list_filter(regexp_extract_all(question, '[A-Za-z]{{4,}}'), lambda w: NOT list_contains({_STOP}, lower(w))) AS plain FROM asked),
    n AS (SELECT qid, CASE WHEN len(big) > 0 THEN big ELSE plain END AS names FROM a),
    k AS (SELECT qid, count(*) AS records, greatest(count(DISTINCT document_id), count(DISTINCT document_title)) AS documents, coalesce(string_agg(CASE WHEN seq <= 10 THEN lower(concat_ws(' ', document_title, content)) END, ' ' ORDER BY seq), '') AS text FROM numbered GROUP BY qid),
    c AS (SELECT qid, coalesce(records, 0) AS records, coalesce(documents, 0) AS documents, CASE WHEN len(names) = 0 OR coalesce(records, 0) = 0 THEN 0 ELSE round(len(list_filter(names, lambda w: contains(text, lower(w)))) / len(names), 4) END AS coverage FROM n LEFT JOIN k USING (qid))
    SELECT qid, records, documents, coverage, CASE WHEN coverage < 0.35 THEN 'INSUFFICIENT' WHEN documents >= 2 AND coverage >= 0.7 THEN 'HIGH' WHEN documents >= 1 AND coverage >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""")
def x7_sufficiency(spark, d):
    return evidence.sufficiency(asked(spark, d), evidence.registered(records(spark, d, "qid", "score", "content", "document_title", "document_id")))


def _tenor(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@query("x8_conflicts", f"""
    WITH {_ONCE}, t AS (SELECT qid, record_id, lower(concat_ws(' ', content, source_characteristics.claim_strength)) AS text FROM once WHERE qid IS NOT NULL),
    s AS ({" UNION ALL ".join(f"SELECT qid, record_id, {i} AS tenor, {_tenor(n)} AS n, {_tenor(p)} AS p FROM t" for i, (n, p) in enumerate(evidence.OPPOSED))}),
    pairs_ AS (SELECT x.qid, x.tenor, count(*) AS pairs FROM s x JOIN s y ON x.qid = y.qid AND x.tenor = y.tenor AND x.record_id < y.record_id WHERE (x.n AND y.p) OR (x.p AND y.n) GROUP BY ALL)
    SELECT qid, tenor, sum(n::INT)::BIGINT AS against, sum(p::INT)::BIGINT AS in_favour, any_value(pairs) AS pairs, min(CASE WHEN n THEN record_id END) AS first_against, min(CASE WHEN p THEN record_id END) AS first_in_favour FROM s JOIN pairs_ USING (qid, tenor) GROUP BY qid, tenor""")
def x8_conflicts(spark, d):
    return evidence.conflicts(records(spark, d, "qid", "content", "source_characteristics"))


@query("x10_claims")
def x10_claims(spark, d):
    return evidence.claims(records(spark, d, "content", "source_characteristics"))


@query("x11_context", f"""
    WITH {_SEQ}, s AS (SELECT qid, seq, round(len(regexp_extract_all(content, '\\S+')) * 1.3, 1)::DOUBLE AS tokens FROM numbered),
    r AS (SELECT qid, seq, tokens, round(sum(tokens) OVER (PARTITION BY qid ORDER BY seq), 1) AS total FROM s)
    SELECT qid, format('EVIDENCE_{{:03d}}', seq) AS evidence_id, tokens, total FROM r WHERE total <= 3500 OR seq = 1""")
def x11_context(spark, d):
    return evidence.in_context(evidence.registered(records(spark, d, "qid", "score", "content").filter("content is not null")))


@query("x12_resolved")
def x12_resolved(spark, d):
    return evidence.resolved(table(spark, d, "hybrid_results"), records(spark, d))


@query("x13_citation_issues", f"""
    WITH {_ONCE}, c AS (SELECT result_id, qid, unnest(regexp_extract_all(answer, 'EVIDENCE_(\\d+)', 1))::BIGINT AS number FROM hybrid_results), h AS (SELECT qid, regexp_extract(id, '(\\d+)', 1)::BIGINT AS number, max(length(trim(coalesce(content, '')))) AS size FROM once GROUP BY ALL)
    SELECT result_id, number, CASE WHEN size IS NULL THEN 'missing' ELSE 'unsupported' END AS issue FROM c LEFT JOIN h USING (qid, number) WHERE size IS NULL OR size = 0""")
def x13_citation_issues(spark, d):
    return evidence.citation_issues(table(spark, d, "hybrid_results"), records(spark, d, "qid", "id", "content"))


@query("x15_verified")
def x15_verified(spark, d):
    return evidence.verified(table(spark, d, "hybrid_results"), records(spark, d, "qid", "id", "content"))


@query("x16_judged")
def x16_judged(spark, d):
    return evidence.judged(table(spark, d, "hybrid_results"), records(spark, d))


@query("x14_citation_details", f"""
    WITH {_ONCE}, c AS (SELECT DISTINCT result_id, qid, number FROM (SELECT result_id, qid, unnest(regexp_extract_all(answer, 'EVIDENCE_(\\d+)', 1))::BIGINT AS number FROM hybrid_results)), r AS (SELECT *, regexp_extract(id, '(\\d+)', 1)::BIGINT AS number FROM once)
    SELECT result_id, number, record_id, coalesce(document_title, 'Archive Document') AS document_title, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS excerpt FROM c JOIN r USING (qid, number)""")
def x14_citation_details(spark, d):
    return evidence.citation_details(table(spark, d, "hybrid_results"), records(spark, d)).drop("place")


# --- metrics

@query("m7_support")
def m7_support(spark, d):
    return metrics.support(table(spark, d, "hybrid_results"))


@query("m2_recall_mrr", """
    WITH g AS (SELECT DISTINCT chunk_id FROM evidence_records WHERE chunk_id IS NOT NULL), r AS (SELECT result_id, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) AS spot FROM hybrid_results),
    f AS (SELECT h.result_id, min(CASE WHEN g.chunk_id IS NOT NULL THEN spot END) AS first FROM hybrid_results h LEFT JOIN r USING (result_id) LEFT JOIN g USING (chunk_id) GROUP BY h.result_id)
    SELECT result_id, CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_1, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_3, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_5, CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_10, round(coalesce(1 / first, 0), 4) AS mrr FROM f""")
def m2_recall_mrr(spark, d):
    return metrics.recall_and_mrr(metrics.ranked_hits(table(spark, d, "hybrid_results"), table(spark, d, "evidence_records")))


@query("m6_grounding", "WITH k AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL), c AS (SELECT result_id, unnest(citations) AS c FROM hybrid_results) SELECT result_id, count(*) AS cited, sum(CASE WHEN k.title IS NOT NULL AND trim(coalesce(c.excerpt, '')) <> '' THEN 1 ELSE 0 END)::BIGINT AS grounded FROM c LEFT JOIN k ON k.title = c.document_title GROUP BY result_id")
def m6_grounding(spark, d):
    return metrics.grounding(table(spark, d, "hybrid_results"), table(spark, d, "documents"))


_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, experiment ORDER BY run_at DESC, result_id DESC) AS n FROM hybrid_results) WHERE n = 1)"


@query("m8_experiments", f"""
    WITH {_LAST} SELECT experiment, count(*) AS questions, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_3), 6) AS recall_at_3, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(total_time_sec), 6) AS total_time_sec, round(avg(citation_grounded::INT), 6) AS grounded FROM l GROUP BY experiment""")
def m8_experiments(spark, d):
    return metrics.by_experiment(table(spark, d, "hybrid_results"))


@query("m9_compared", f"WITH {_LAST} SELECT qid, a.mrr AS mrr_one, b.mrr AS mrr_other, CASE WHEN b.mrr > a.mrr THEN 'improved' WHEN b.mrr < a.mrr THEN 'worse' ELSE 'same' END AS change FROM (SELECT * FROM l WHERE experiment = 'E1_bm25') a JOIN (SELECT * FROM l WHERE experiment = 'E4_hybrid') b USING (qid)")
def m9_compared(spark, d):
    return metrics.compared(table(spark, d, "hybrid_results"), "E1_bm25", "E4_hybrid")


# --- browsing

@query("a1_documents", "SELECT d.doc_id, any_value(d.title) AS title, count(DISTINCT p.page_id) AS pages FROM documents d LEFT JOIN page_contents p ON p.document_id = d.id GROUP BY d.doc_id")
def a1_documents(spark, d):
    pages = table(spark, d, "page_contents").filter("document_id is not null").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("page_id").alias("pages"))
    return table(spark, d, "documents").select("doc_id", "id", "title").join(pages, "id", "left").select("doc_id", "title", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("a2_document_detail", "SELECT doc_id, title, source_category, list_count(string_split(coalesce(text, ''), chr(10))) AS lines, (SELECT count(DISTINCT record_id) FROM evidence_records WHERE document_id = d.id) AS records FROM documents d")
def a2_document_detail(spark, d):
    cited_ = table(spark, d, "evidence_records").filter("document_id is not null").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("record_id").alias("records"))
    rows = table(spark, d, "documents").select("doc_id", "id", "title", "source_category", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("lines"))
    return rows.join(cited_, "id", "left").select("doc_id", "title", "source_category", "lines", F.coalesce("records", F.lit(0)).alias("records"))


@query("a3_reading_order", "SELECT file_path, page_id, row_number() OVER (PARTITION BY file_path ORDER BY page_number NULLS FIRST, extracted_at NULLS FIRST, page_id) AS place FROM page_contents WHERE file_path IS NOT NULL")
def a3_reading_order(spark, d):
    by = Window.partitionBy("file_path").orderBy("page_number", "extracted_at", "page_id")
    return table(spark, d, "page_contents").filter("file_path is not null").select("file_path", "page_id", F.row_number().over(by).alias("place"))


@query("a4_top_entities", "SELECT entity_id, name, coalesce(mention_count, 0) AS mention_count FROM entities ORDER BY coalesce(mention_count, 0) DESC, entity_id LIMIT 150")
def a4_top_entities(spark, d):
    return table(spark, d, "entities").select("entity_id", "name", F.coalesce("mention_count", F.lit(0)).alias("mention_count")).orderBy(F.desc("mention_count"), "entity_id").limit(150)


@query("a5_entity_chunks", f"WITH {_NAMED} SELECT id, count(DISTINCT chunk_id) AS chunks, array_to_string(list_sort(list(DISTINCT chunk_id))[1:20], ',') AS first_chunks FROM named WHERE chunk_id IS NOT NULL GROUP BY id")
def a5_entity_chunks(spark, d):
    rows = entities.links(table(spark, d, "extracted_entities")).select("id", "chunk_id").distinct()
    return rows.groupBy("id").agg(F.count("*").alias("chunks")).join(graph.first_few(rows, ["id"], "chunk_id", 20, "first_chunks"), "id")


@query("a8_document_files", """
    WITH p AS (SELECT document_id, min(file_path) AS path FROM page_contents WHERE document_id IS NOT NULL AND file_path IS NOT NULL GROUP BY document_id), e AS (SELECT document_id, min(source_file) AS path FROM evidence_records WHERE document_id IS NOT NULL AND source_file IS NOT NULL GROUP BY document_id)
    SELECT doc_id, coalesce(source_path, p.path, e.path) AS path FROM documents LEFT JOIN p ON p.document_id = id LEFT JOIN e ON e.document_id = id""")
def a8_document_files(spark, d):
    """A document's file: its own, else one of its pages', else one of its evidence's."""
    first = lambda t, c, n: table(spark, d, t).filter(f"document_id is not null and {c} is not null").groupBy(F.col("document_id").alias("id")).agg(F.min(c).alias(n))
    rows = table(spark, d, "documents").select("doc_id", "id", "source_path").join(first("page_contents", "file_path", "p"), "id", "left").join(first("evidence_records", "source_file", "e"), "id", "left")
    return rows.select("doc_id", F.coalesce("source_path", "p", "e").alias("path"))


# --- ingestion: chunks by category, gazette, entities of texts, aliases, stored relations

def _counted(text: str) -> str:
    return f"greatest(1, floor(len(regexp_extract_all({text}, '\\S+')) * 1.3))::BIGINT"


def _bare(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _folded(paragraphs: str, most: int = 512, overlap: int = 100) -> str:
    """SQL of a list of paragraphs gathered into chunks, with overlap."""
    held = "list_transform({}.held, lambda h: h.p)"
    joined = lambda a: f"array_to_string({held.format(a)}, chr(10) || chr(10))"
    pieces = f"list_transform(list_filter(list_transform({paragraphs}, lambda p: {_bare('p')}), lambda p: p <> ''), lambda p: struct_pack(held := [struct_pack(p := p, n := {_counted('p')})], size := {_counted('p')}, done := []::VARCHAR[]))"
    tail = f"a.held[list_min(list_filter(range(1, len(a.held) + 2), lambda i: coalesce(list_sum(list_transform(a.held[i:], lambda h: h.n)), 0) <= {overlap})):]"
    state = "struct_pack(held := list_concat({0}, x.held), size := (coalesce(list_sum(list_transform({0}, lambda h: h.n)), 0) + x.size)::BIGINT, done := {1})"
    step = f"CASE WHEN len(a.held) > 0 AND a.size + x.size > {most} THEN {state.format(tail, f'list_append(a.done, {joined("a")})')} ELSE {state.format('a.held', 'a.done')} END"
    start = "struct_pack(held := []::STRUCT(p VARCHAR, n BIGINT)[], size := 0::BIGINT, done := []::VARCHAR[])"
    # a list of one is unpacked, so that the fold is computed once
    return f"list_transform([list_reduce({pieces}, lambda a, x: {step}, {start})], lambda f: CASE WHEN len(f.held) > 0 THEN list_append(f.done, {joined('f')}) ELSE f.done END)[1]"


SQL["t2_chunks"] = f"""
    WITH c AS (SELECT doc_id, {_folded("string_split_regex(text, '\\n\\s*\\n')")} AS c FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (position - 1)::INT AS position, chunk, {_counted('chunk')}::INT AS token_count FROM (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS position FROM c)"""

_PIECES = "list_transform({c}, lambda c: struct_pack(section_title := {t}, chunk := c, counted := c))"


@query("t3_chunks_by_category", f"""
    WITH d AS (SELECT doc_id, title, lower(coalesce(source_category, '')) AS category, text, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(#{{1,6}}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda s: struct_pack(title := nullif(trim(regexp_extract(s, '^#{{1,6}}\\s+([^\\n]*)', 1)), ''), body := {_bare("regexp_replace(s, '^#{1,6}\\s[^\\n]*\\n?', '')")})), lambda s: regexp_matches(s.body, '\\S')) AS sections,
        list_transform(regexp_extract_all(text, '(?m)((?:^[ \\t]*\\|[^\\n]*\\|[ \\t]*(?:\\n|$))+)', 1), lambda t: array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda r: regexp_matches(r, '\\S')), lambda r: array_to_string(list_transform(string_split(regexp_replace(trim(r), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c)), ' | ')), chr(10))) AS tables FROM documents WHERE regexp_matches(text, '\\S')),
    p AS (SELECT doc_id, category, CASE category WHEN 'wiki' THEN flatten(list_transform(sections, lambda s: CASE WHEN {_counted('s.body')} > 512 THEN {_PIECES.format(c=_folded("string_split(s.body, chr(10) || chr(10))"), t='s.title')} ELSE [struct_pack(section_title := s.title, chunk := s.body, counted := s.body)] END))
        WHEN 'chronicles' THEN flatten(list_transform(sections, lambda s: {_PIECES.format(c=_folded("string_split(s.body, chr(10) || chr(10))"), t='s.title')}))
        WHEN 'codex' THEN list_concat(list_transform(tables, lambda t: struct_pack(section_title := 'Data Table', chunk := 'Table: ' || coalesce(title, '') || chr(10) || t, counted := t)), flatten(list_transform(sections, lambda s: {_PIECES.format(c=_folded("string_split(s.body, chr(10) || chr(10))"), t='s.title')})))
        ELSE {_PIECES.format(c=_folded(f"string_split({_bare('text')}, chr(10) || chr(10))"), t='title')} END AS pieces FROM d),
    u AS (SELECT doc_id, category, unnest(pieces) AS c, (generate_subscripts(pieces, 1) - 1)::INT AS position FROM p)
    SELECT doc_id, position, c.section_title AS section_title, c.chunk AS chunk, {_counted('c.counted')}::INT AS token_count, greatest(1, position // 2 + 1)::INT AS page, CASE WHEN category = 'wiki' THEN position * 25 + 1 END::INT AS line_start,
        CASE WHEN category = 'wiki' THEN position * 25 + 1 + len(string_split(c.chunk, chr(10))) END::INT AS line_end FROM u""")
def t3_chunks_by_category(spark, d):
    return chunking.chunks_by_category(table(spark, d, "documents"))


_SPOKEN = "array_to_string(list_transform(list_filter(string_split({}, '_'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_BOXED = " ".join(f"WHEN list_contains([{', '.join(repr(f) for f in fs)}], f) THEN '{t}'" for t, fs in naming.BOX.items())


@query("e1_gazette", f"""
    WITH f AS (SELECT source_path AS path, string_split(source_path, '/')[1] AS folder, regexp_replace(list_extract(string_split(source_path, '/'), -1), '\\.[^.]+$', '') AS stem, lower(regexp_extract(source_path, '\\.([^.]+)$', 1)) AS format, coalesce(text, '') AS text FROM documents WHERE source_path IS NOT NULL),
    w AS (SELECT path, stem, regexp_extract(stem, '^wiki_(person|faction|place|creature|artifact|event|organization)_', 1) AS kind, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l,
        list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*\\|+[ \\t]*([^|\\n]*[^|\\s])', 1), lambda x: lower(x)), lambda f: (CASE {_BOXED} END) IS NOT NULL)[1] AS f FROM f WHERE folder = 'wiki' AND format = 'md'),
    h AS (SELECT path, {_SPOKEN.format("regexp_replace(stem, '^wiki_(person|faction|place|creature|artifact|event|organization)_', '')")} AS own, coalesce(nullif(upper(kind), ''), CASE {_BOXED} END, 'UNKNOWN') AS t,
        trim(regexp_replace(CASE WHEN regexp_matches(trim(regexp_replace(l[1], '^[# ]+', '')), '^!\\[.+?\\]') THEN trim(regexp_extract(trim(regexp_replace(l[1], '^[# ]+', '')), '^!\\[(.*?)\\]', 1)) WHEN l[1] LIKE '#%' THEN trim(regexp_replace(l[1], '^[# ]+', '')) WHEN l[2] LIKE '#%' THEN trim(regexp_replace(l[2], '^[# ]+', '')) END, '(?i)\\s*\\((?:faction|character|conflict|location|place)\\)', '', 'g')) AS heading FROM w),
    n AS (SELECT 1 AS turn, path, unnest([coalesce(nullif(heading, ''), own), own]) AS name, t FROM h UNION ALL SELECT 0, path, {_SPOKEN.format('stem')}, 'DOCUMENT' FROM f WHERE folder = 'codex' AND format = 'pdf'),
    b AS (SELECT turn, path, name, t FROM n UNION ALL SELECT turn, path, name[5:], t FROM n WHERE turn = 1 AND lower(name) LIKE 'the %')
    SELECT name, first(t ORDER BY turn, path, t) AS entity_type FROM b WHERE name <> '' GROUP BY name""")
def e1_gazette(spark, d):
    return naming.gazette(table(spark, d, "documents").select(F.col("source_path").alias("path"), "text"))


_FORMS = "forms AS (SELECT trim(form) AS form, name, entity_type FROM (SELECT name AS form, name, entity_type FROM entities UNION ALL SELECT unnest(aliases), name, entity_type FROM entities UNION ALL SELECT title, title, 'DOCUMENT' FROM documents) WHERE form IS NOT NULL AND name IS NOT NULL AND length(trim(form)) >= 2 AND NOT regexp_matches(trim(form), '^[0-9]+$'))"


def _forms(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "entities").select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"), "name", "entity_type")
    return known.unionByName(table(spark, d, "documents").select(F.col("title").alias("form"), F.col("title").alias("name"), F.lit("DOCUMENT").alias("entity_type")))


@query("e3_entities_of_texts", f"""
    WITH {_ONCE}, {_FORMS}, gazette AS (SELECT said, min(form) AS entity, len(string_split(said, ' ')) AS size FROM (SELECT form, array_to_string(regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+'), ' ') AS said FROM forms) WHERE said <> '' GROUP BY said),
    about AS (SELECT form AS entity, arg_min(struct_pack(name := name, entity_type := entity_type), (name, coalesce(entity_type, ''))) AS e FROM forms GROUP BY form),
    spans AS (SELECT record_id, entity, n FROM (SELECT key AS record_id, entity, n FROM {_matched('record_id', 'content', 'once').replace(f'range(1, {MOST + 1})', 'range(1, 7)')}))
    SELECT record_id, e.name AS name, min(e.entity_type) AS entity_type, array_to_string(list_sort(list(DISTINCT entity)), '|') AS mentions, sum(n)::BIGINT AS n, 'gazette' AS source, 1.0::DOUBLE AS confidence FROM spans JOIN about USING (entity) GROUP BY record_id, e.name""")
def e3_entities_of_texts(spark, d):
    """Entities of each record, by the names and aliases known and the titles of documents."""
    return naming.entities_of(records(spark, d, "content"), _forms(spark, d), "record_id", "content")


_CORE = "lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '(?i)^(ser|lord|lady|high|the)\\s+', ''), '(?i)\\s+the\\s+\\S+$', ''), '(?i)\\s+of\\s+(the\\s+)?\\S+(\\s+\\S+)?$', '')))"
_NEAR = "(lower({0}.name) = lower({1}.name) OR ({0}.core <> '' AND {0}.core = {1}.core) OR (length({0}.core) > 4 AND length({1}.core) > 4 AND abs(length({0}.core) - length({1}.core)) <= 2 AND levenshtein({0}.core, {1}.core) <= 2))"


@query("e9_resolved", f"""
    WITH m AS (SELECT trim(name) AS name, max(CASE source WHEN 'gazette' THEN 3 WHEN 'gemini_ner' THEN 2 WHEN 'rules' THEN 1 ELSE 0 END) AS r FROM extracted_entities WHERE trim(name) <> '' GROUP BY 1),
    g AS (SELECT DISTINCT trim(name) AS name FROM entities WHERE source = 'gazette' AND trim(name) <> ''),
    rows_ AS (SELECT name, {_CORE.format('name')} AS core, row_number() OVER (ORDER BY -r, length(name), name) AS place FROM m), seeds AS (SELECT name, {_CORE.format('name')} AS core, row_number() OVER (ORDER BY lower(name) LIKE 'the %', length(name), name) - 1000000000 AS place FROM g),
    heads AS (SELECT unnest(list_reduce((SELECT list([struct_pack(name := name, core := core, place := place)] ORDER BY place) FROM rows_), lambda a, x: CASE WHEN len(list_filter(a, lambda y: {_NEAR.format('x[1]', 'y')})) > 0 THEN a ELSE list_concat(a, x) END,
        (SELECT coalesce(list(struct_pack(name := name, core := core, place := place) ORDER BY place), []) FROM seeds))) AS h)
    SELECT r.name AS name, arg_min(h.name, h.place) AS canonical FROM rows_ r JOIN heads ON {_NEAR.format('r', 'h')} AND h.place <= r.place GROUP BY r.name""")
def e9_resolved(spark, d):
    """Which name stands for each of the extracted ones; names of entities from the gazette come first."""
    return naming.resolved(table(spark, d, "extracted_entities"), table(spark, d, "entities").filter("source = 'gazette'"))


def _beside(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the archive: names that are mentioned in one chunk."""
    rows = entities.distinct_mentions(table(spark, d, "extracted_entities")).filter("chunk_id is not null")
    x, y = rows.select("chunk_id", F.col("mention_id").alias("x"), F.col("name").alias("source"), F.col("confidence").alias("cx")), rows.select("chunk_id", F.col("mention_id").alias("y"), F.col("name").alias("target"), F.col("confidence").alias("cy"))
    return x.join(y, "chunk_id").filter("x < y").select("source", "target", F.lit("MENTIONED_WITH").alias("relation"), F.least("cx", "cy").alias("confidence"), (F.col("x") * 10000000 + F.col("y")).alias("seq"))


_BESIDE = f"{_NAMED}, beside AS (SELECT x.name AS source, y.name AS target, 'MENTIONED_WITH' AS relation, least(x.confidence, y.confidence) AS confidence, x.mention_id * 10000000 + y.mention_id AS seq FROM named x JOIN named y ON x.chunk_id = y.chunk_id AND x.mention_id < y.mention_id)"
_BEARERS = """f AS (SELECT entity_id, coalesce(mention_count, 0) AS m, lower(name) AS said, 1 AS exact FROM entities UNION ALL SELECT entity_id, coalesce(mention_count, 0), lower(unnest(aliases)), 0 FROM entities),
    bearers AS (SELECT said, e.id AS id FROM (SELECT said, first(entity_id ORDER BY exact DESC, m DESC, entity_id) AS entity_id FROM f WHERE said IS NOT NULL GROUP BY said) JOIN entities e USING (entity_id))"""
_STORED = f"""{_BESIDE}, {_BEARERS}, stored AS (SELECT source_id, target_id, relation, arg_max(confidence, (seq, coalesce(confidence, -1))) AS confidence, max(seq) AS seq FROM (SELECT a.id AS source_id, b.id AS target_id, relation, confidence, seq FROM beside JOIN bearers a ON a.said = lower(source) JOIN bearers b ON b.said = lower(target)) GROUP BY ALL)"""


@query("r5_mentioned_together", f"WITH {_BESIDE} SELECT source, target, relation, confidence, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target), relation ORDER BY seq) AS n FROM beside WHERE lower(source) <> lower(target)) WHERE n = 1")
def r5_mentioned_together(spark, d):
    return graph.deduplicated(_beside(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "entities")
    found = entities.looked_up(table(spark, d, "extracted_entities"), known).join(known.select("entity_id", "id"), "entity_id").select("asked", "id")
    return graph.stored(_beside(spark, d), found, known)


@query("r6_stored", f"WITH {_STORED} SELECT * FROM stored")
def r6_stored(spark, d):
    """Relations between known entities, resolved by name or alias; the last of each kind and pair stands."""
    return _stored(spark, d)


@query("r9_by_type", "SELECT upper(coalesce(entity_type, 'UNKNOWN')) AS entity_type, entity_id, name, row_number() OVER (PARTITION BY upper(coalesce(entity_type, 'UNKNOWN')) ORDER BY coalesce(mention_count, 0) DESC, entity_id) AS rank FROM entities")
def r9_by_type(spark, d):
    """The entities of every type, those mentioned most first."""
    kind = F.upper(F.coalesce("entity_type", F.lit("UNKNOWN")))
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.coalesce("mention_count", F.lit(0)).desc(), "entity_id"))
    return table(spark, d, "entities").select(kind.alias("entity_type"), "entity_id", "name", "mention_count").withColumn("rank", rank).drop("mention_count")


_GRAPH = f"""{_STORED}, edges AS (SELECT source_id || '>' || target_id AS edge, source_id AS src, target_id AS dst FROM stored WHERE source_id <> target_id), both_ AS (SELECT edge, src AS a, dst AS b FROM edges UNION ALL SELECT edge, dst, src FROM edges)"""


def _entity_edges(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).filter("source_id <> target_id").select(F.concat_ws(">", "source_id", "target_id").alias("edge"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


@query("r11_related_entities", f"WITH {_GRAPH} SELECT DISTINCT a AS node, b AS neighbour FROM both_")
def r11_related_entities(spark, d):
    return graph.related(_entity_edges(spark, d), table(spark, d, "entities").select(F.col("id").alias("node")))


_ENTITY_TRAILS = f"t(seed, node, hops, path, used) AS (SELECT id, id, 0, id, []::VARCHAR[] FROM entities UNION ALL SELECT seed, b, hops + 1, path || ' > ' || b, list_append(used, edge) FROM t JOIN both_ ON node = a WHERE hops < 2 AND NOT list_contains(used, edge))"


@query("r13_entity_trails", f"WITH RECURSIVE {_GRAPH}, {_ENTITY_TRAILS} SELECT seed, node, hops, path FROM t WHERE seed <> node")
def r13_entity_trails(spark, d):
    """Trails of two hops from every entity."""
    return graph.trails(_entity_edges(spark, d), table(spark, d, "entities").select(F.col("id").alias("node")), 2)


@query("r14_reached_entities", f"WITH RECURSIVE {_GRAPH}, {_ENTITY_TRAILS} SELECT seed, node, min(hops) AS hops, count(DISTINCT path) AS paths FROM t WHERE seed <> node GROUP BY seed, node")
def r14_reached_entities(spark, d):
    return graph.reached(r13_entity_trails(spark, d))


# --- SQL of what is asked of questions: names, lexical queries, types, sub-questions

def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# Spark's word boundaries know letters of any script, DuckDB's only those of ASCII: other words are blotted out before patterns with boundaries.
_LEADS = _re("^(" + "|".join(questions.LEADS) + ")")
_PARTS = f"""{_ASKED}, blotted AS (SELECT qid, question, regexp_replace(regexp_replace(question, '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', chr(1), 'g'), '[\\p{{L}}\\p{{N}}_]*[^\\x00-\\x7F][\\p{{L}}\\p{{N}}_]*', chr(2), 'g') AS plain FROM asked),
    parts AS (SELECT qid, question, plain, regexp_extract_all(plain, {_re(questions.WORDS)}, 1) AS words, list_concat(list_filter(list_transform(regexp_extract_all(question, {_re(questions.QUOTED)}, 1), lambda x: trim(x)), lambda x: length(x) > 2), regexp_extract_all(plain, {_re(questions.TITLED)}, 1),
        list_filter(regexp_extract_all(plain, {_re(questions.EPITHET)}, 1), lambda x: NOT regexp_matches(lower(x), {_LEADS}) AND length(x) > 3), list_filter(regexp_extract_all(plain, {_re(questions.CAPITALS)}, 1), lambda x: NOT regexp_matches(lower(x), {_LEADS}) AND length(x) > 3)) AS said FROM blotted),
    firsts AS (SELECT *, list_reduce(list_transform(said, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: lower(y) = lower(x[1]))) > 0 THEN a ELSE list_concat(a, x) END, []::VARCHAR[]) AS firsts FROM parts),
    names_ AS (SELECT qid, question, plain, words, list_reduce(list_transform(list_filter(words[2:], lambda w: regexp_matches(w, '^[A-Z]') AND NOT list_contains({_STOP}, lower(w)) AND length(w) > 3), lambda w: [w]), lambda a, w: CASE WHEN len(list_filter(a, lambda y: contains(lower(y), lower(w[1])))) > 0 THEN a ELSE list_concat(a, w) END, firsts) AS names FROM firsts),
    kinds AS (SELECT *, CASE WHEN regexp_matches(plain, {_re("(?i)" + "|".join(questions.COMPARISON))}) THEN 'comparison' WHEN regexp_matches(plain, {_re("(?i)" + "|".join(questions.MULTI_HOP))}) THEN 'multi_hop' WHEN len(names) >= 2 THEN 'multi_entity' ELSE 'simple' END AS kind,
        coalesce(nullif(trim(concat_ws(' ', nullif(array_to_string(names, ' '), ''), nullif(array_to_string(list_filter(words, lambda t: NOT list_contains({_STOP}, lower(t)) AND NOT contains(lower(array_to_string(names, ' ')), lower(t)) AND length(t) > 2), ' '), ''))), ''), question) AS query FROM names_)"""


def _said(pattern: str, template: str) -> str:
    """SQL of a template of sub-questions, filled with the groups of its pattern."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        group = f"trim(regexp_extract(q, {_re('(?i)' + pattern)}, {name.strip('!')}))"
        parts += [_re(before), f"upper({group}[1]) || lower({group}[2:])" if name.endswith("!") else group]
    return " || ".join(parts + [_re(rest)])


_HEAD, _TAIL = (f"trim(regexp_extract(q, {_re('(?i)' + questions.SPLIT)}, {i}))" for i in (1, 3))
_SUB = f"""subs AS (SELECT *, CASE WHEN q = '' THEN []::VARCHAR[] {" ".join(f"WHEN regexp_matches(q, {_re('(?i)' + p)}) THEN [{_said(p, one)}, {_said(p, two)}]" for p, one, two in questions.TEMPLATES)}
    WHEN regexp_matches(q, {_re("(?i)" + questions.SPLIT)}) AND regexp_matches(q, '(?i)which|what|who|where|whose') AND len(string_split_regex({_HEAD}, '\\s+')) >= 3 AND len(string_split_regex({_TAIL}, '\\s+')) >= 3 THEN ['Which entity ' || {_TAIL} || '?', {_HEAD} || ' that entity?'] ELSE [q] END AS subs FROM (SELECT *, trim(question) AS q FROM kinds))"""
SQL["q1_names"] = f"WITH {_PARTS} SELECT qid, array_to_string(names, '|') AS names FROM names_"
SQL["q2_lexical_query"] = f"WITH {_PARTS} SELECT qid, query FROM kinds"
SQL["q3_composed"] = f"WITH {_PARTS} SELECT qid, kind FROM kinds"
SQL["q4_sub_questions"] = f"WITH {_PARTS}, {_SUB} SELECT qid, (generate_subscripts(subs, 1) - 1)::INT AS no, unnest(subs) AS question FROM subs"
SQL["q5_analysis"] = f"WITH {_PARTS}, {_SUB} SELECT qid, kind, len(names)::INT AS names, query, CASE WHEN kind = 'multi_hop' THEN array_to_string(subs, '|') ELSE '' END AS sub_questions FROM subs"


@query("x6_state_sufficiency", f"""
    WITH {_PARTS}, {_SEQ.replace(_ONCE + ',', _ONCE + ',')}, k AS (SELECT qid, count(*) AS records, greatest(count(DISTINCT document_id), count(DISTINCT document_title)) AS documents, coalesce(string_agg(CASE WHEN seq <= 10 THEN lower(concat_ws(' ', document_title, content)) END, ' ' ORDER BY seq), '') AS text FROM numbered GROUP BY qid),
    s AS (SELECT qid, kind, coalesce(records, 0) AS records, coalesce(documents, 0) AS documents, len(list_filter(names, lambda n: NOT contains(coalesce(text, ''), lower(n)))) AS missing, 1 - missing / greatest(len(names), 1) AS held FROM kinds LEFT JOIN k USING (qid))
    SELECT qid, records, documents, missing::INT AS missing, level, CASE WHEN records = 0 THEN 0 WHEN kind = 'multi_hop' THEN CASE level WHEN 'HIGH' THEN 0.95 WHEN 'MEDIUM' THEN 0.65 WHEN 'LOW' THEN 0.4 ELSE 0.1 END ELSE CASE level WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.6 ELSE 0.3 END END::DOUBLE AS coverage FROM (
        SELECT *, CASE WHEN records = 0 THEN 'INSUFFICIENT' WHEN kind = 'multi_hop' THEN CASE WHEN documents >= 2 AND held >= 0.5 THEN 'MEDIUM' WHEN documents >= 1 AND held >= 0.5 THEN 'LOW' ELSE 'INSUFFICIENT' END WHEN held >= 0.8 THEN 'HIGH' WHEN held >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s)""")
def x6_state_sufficiency(spark, d):
    """The evidence registered for each question, as one hop: composed questions never have enough of one hop alone."""
    q = F.col("question")
    states = asked(spark, d).select("qid", questions.kind(q, questions.names(q)).alias("kind"), questions.names(q).alias("names"), F.lit(1).alias("hops"))
    have = evidence.registered(records(spark, d, "qid", "score", "content", "document_title", "document_id"))
    return evidence.state_sufficiency(states, have.select("qid", F.col("seq").alias("rank"), "document_id", "document_title", "content"))


def _of_source(values: tuple) -> str:
    return "struct_pack(" + ", ".join(f"{n} := '{v}'" for n, v in zip(evidence.TRAITS, values, strict=True)) + ")"


_KIND_OF = " ".join(f"WHEN stem LIKE '{p.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}' THEN {_of_source(v)}" for p, v in evidence.PREFIXES.items())
SQL["x1_sources"] = f"""
    WITH s AS (SELECT DISTINCT source_file, source_category FROM evidence_records), n AS (SELECT *, coalesce(source_file, '') AS file, lower(coalesce(source_category, '')) AS kind, lower(trim(regexp_replace(list_extract(string_split(coalesce(source_file, ''), '/'), -1), '(?i)(\\.scan)?\\.(pdf|docx|md|txt|png|jpe?g)$', ''))) AS stem FROM s),
    t AS (SELECT source_file, source_category, CASE {_KIND_OF} WHEN stem LIKE 'wiki\\_%' ESCAPE '\\' OR kind = 'wiki' OR contains(file, '/wiki/') THEN {_of_source(("wiki", "wiki_article", "assertion", "third_party", "retrospective"))}
        WHEN stem LIKE 'codex\\_%' ESCAPE '\\' OR kind = 'codex' OR contains(file, '/codex/') THEN {_of_source(("codex", "codex_entry", "assertion", "official", "retrospective"))} WHEN contains(stem, 'chronicle') OR kind = 'chronicles' OR contains(file, '/chronicles/') THEN {_of_source(("chronicle", "chronicle_entry", "assertion", "narrative", "retrospective"))}
        WHEN kind = 'ephemera' THEN {_of_source(("ephemera", "unknown", "assertion", "third_party", "retrospective"))} ELSE {_of_source(("unknown", "unknown", "assertion", "third_party", "retrospective"))} END AS t FROM n)
    SELECT source_file, source_category, {", ".join(f"t.{n} AS {n}" for n in evidence.TRAITS)} FROM t"""
_PLACE = """CASE WHEN json_extract_string(metadata, '$.line_start') = 'Plate' OR json_extract_string(metadata, '$.is_asset_chunk') = 'true' THEN 'Plate' WHEN json_extract_string(metadata, '$.reference_location') IS NOT NULL THEN json_extract_string(metadata, '$.reference_location')
    WHEN page IS NOT NULL AND json_extract_string(metadata, '$.line_start') IS NOT NULL AND json_extract_string(metadata, '$.line_end') IS NOT NULL THEN 'p.' || page || ' (Lines ' || json_extract_string(metadata, '$.line_start') || '-' || json_extract_string(metadata, '$.line_end') || ')'
    WHEN page IS NOT NULL AND json_extract_string(metadata, '$.paragraph_start') IS NOT NULL THEN 'p.' || page || ' (Para ' || json_extract_string(metadata, '$.paragraph_start') || ')' WHEN page IS NOT NULL THEN 'p.' || page WHEN json_extract_string(metadata, '$.line_start') IS NOT NULL THEN 'Line ' || json_extract_string(metadata, '$.line_start') ELSE 'p.1' END"""
SQL["x12_resolved"] = f"""
    WITH {_ONCE}, h AS (SELECT qid, number, arg_min(said, record_id) AS said FROM (SELECT qid, try_cast(regexp_extract(id, '(\\d+)', 1) AS BIGINT) AS number, record_id, coalesce(document_title, 'Archive Document') || ', ' || {_PLACE} AS said FROM once) WHERE number IS NOT NULL GROUP BY qid, number),
    a AS (SELECT result_id, qid, string_split_regex(answer, 'EVIDENCE_\\d+') AS texts, regexp_extract_all(answer, 'EVIDENCE_(\\d+)', 1) AS numbers FROM hybrid_results WHERE answer <> ''),
    p AS (SELECT result_id, qid, generate_subscripts(texts, 1) AS spot, unnest(texts) AS before, unnest(list_resize(numbers, len(texts))) AS n FROM a)
    SELECT result_id, string_agg(before || coalesce(said, 'EVIDENCE_' || n, ''), '' ORDER BY spot) AS answer FROM p LEFT JOIN h ON h.qid = p.qid AND number = try_cast(n AS BIGINT) GROUP BY result_id"""
SQL["m7_support"] = """
    WITH r AS (SELECT result_id, regexp_extract_all(regexp_replace(regexp_replace(coalesce(answer, ''), '[\\p{L}_][\\p{L}\\p{N}_]*', 'x', 'g'), '\\d[\\d,]*[\\p{L}_]+', 'x', 'g'), '(\\d+(?:,\\d+)?)', 1) AS n, lower(array_to_string(list_transform(coalesce(citations, []), lambda c: coalesce(c.excerpt, '')), ' ')) AS said, coalesce(len(citations), 0) > 0 AND coalesce(answer, '') <> '' AS answers FROM hybrid_results),
    f AS (SELECT *, len(list_filter(n, lambda x: contains(said, x) OR contains(said, replace(x, ',', '')))) AS found FROM r)
    SELECT result_id, len(n)::INT AS numbers, found::INT AS found, answers AND (len(n) = 0 OR found > 0) AS supported FROM f"""


def _ruled(i: int, pattern: str, predicate: str, strength: str) -> str:
    both = [f"regexp_extract_all(content, {_re('(?i)' + pattern)}, {g})" for g in (1, 2)]
    return f"SELECT record_id, own, {i} AS rule, generate_subscripts({both[0]}, 1) AS spot, unnest({both[0]}) AS s, unnest({both[1]}) AS o, '{predicate}' AS predicate, '{strength}' AS w FROM texts"


SQL["x10_claims"] = f"""
    WITH {_ONCE}, texts AS (SELECT record_id, content, coalesce(source_characteristics.claim_strength, 'assertion') AS own FROM once WHERE content IS NOT NULL), c AS ({" UNION ALL ".join(_ruled(i, *rule) for i, rule in enumerate(evidence.CLAIMS))})
    SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY rule, spot)::INT AS claim_no, trim(regexp_replace(trim(s), '(?i)\\s+\\b(was|is|were|are|been|had)\\b.*$', '')) AS subject, predicate, trim(o) AS object, CASE WHEN w <> 'assertion' THEN w ELSE own END AS strength FROM c"""
SQL["v6_reranked"] = f"""
    WITH {_ASKED}, {_SEQ}, {_TERMS}, t AS (SELECT qid, list(term) AS terms FROM terms GROUP BY qid),
    r AS (SELECT qid, record_id AS chunk, seq AS before, round(len(list_filter(coalesce(terms, []), lambda x: list_contains(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), x))) / greatest(len(coalesce(terms, [])), 1), 6) AS score FROM numbered JOIN asked USING (qid) LEFT JOIN t USING (qid) WHERE seq <= 30 AND content IS NOT NULL)
    SELECT qid, chunk, score, rank, before FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM r) WHERE rank <= 20"""
