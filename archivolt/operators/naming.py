"""The gazette that an archive's files tell, the entities of texts, and the names that mean the same entity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import core_name
from archivolt.operators.entities import gazette_matches, source_rank
from archivolt.plans.session import cut, width

# What the beginnings of pictures' and wiki pages' names, the categories of plates and the fields of
# information boxes tell of an entity's type.
PICTURES = {
    "atmo_portrait_character_": "PERSON", "atmo_heraldry_faction_": "FACTION", "atmo_landscape_location_": "PLACE", "atmo_battle_painting_conflict_": "EVENT",
    "atmo_creature_creature_": "CREATURE", "atmo_relic_artifact_": "ARTIFACT",
}
PAGES = {f"wiki_{t.lower()}_": t for t in ("PERSON", "FACTION", "PLACE", "CREATURE", "ARTIFACT", "EVENT", "ORGANIZATION")}
PLATES = {
    "person": "PERSON", "character": "PERSON", "faction": "FACTION", "place": "PLACE", "location": "PLACE", "region": "PLACE", "event": "EVENT", "conflict": "EVENT", "battle": "EVENT",
    "artifact": "ARTIFACT", "relic": "ARTIFACT", "creature": "CREATURE", "beast": "CREATURE", "organization": "ORGANIZATION", "order": "ORGANIZATION", "guild": "ORGANIZATION",
}
BOX = {
    "PERSON": ("role", "born", "died", "physical traits", "demeanor"),
    "PLACE": ("region", "founded", "status", "elevation"),
    "CREATURE": ("threat rating", "lair", "diet"),
    "ARTIFACT": ("attunement cost", "forged at", "place of housing", "wielder"),
    "EVENT": ("belligerents", "date", "outcome", "major fighting"),
    "FACTION": ("organization kind", "organization type", "membership", "leader", "headquarters", "members", "command"),
}


def _started(stem: Column, table: dict[str, str]) -> Column:
    """(type, rest) of a stem by what it begins with; nulls where it begins with nothing known."""
    none = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("rest"))
    return reduce(lambda e, kv: F.when(stem.startswith(kv[0]), F.struct(F.lit(kv[1]).alias("type"), F.substring(stem, F.lit(len(kv[0]) + 1), F.length(stem)).alias("rest"))).otherwise(e), table.items(), none)


def spoken(stem: Column) -> Column:
    """A file's slug as a name: its words with capitals."""
    return F.trim(F.regexp_replace(F.initcap(F.regexp_replace(stem, "_", " ")), " +", " "))


def gazette(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(name, entity_type): the names that files tell, each once.

    Pictures and plates tell type and name by their file's name. Pages of the wiki (``.md``) tell the name of their file and of their
    heading; the type is that of a picture of either name, else of the page's prefix, else of the first telling field of its information
    box, else UNKNOWN. Files of the codex (``.pdf``) are documents. Of several files that tell one name codex goes before wiki before pictures,
    then the first path. "The X" is also "X". Null paths tell nothing; null texts have no heading and no fields.
    """
    name = F.element_at(F.split(path, "/"), -1)
    rows = files.filter(F.col(path).isNotNull()).select(
        F.col(path).alias("path"), F.split(path, "/")[0].alias("folder"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.coalesce(text, F.lit("")).alias("text")
    )
    kinds = F.create_map(*[F.lit(x) for kv in PLATES.items() for x in kv])
    plate = r"^plate_[^_]*_([^_]+)_(.+)$"
    picture = _started(F.col("stem"), PICTURES)
    seen = rows.filter("format = 'png'").select("path", F.when(F.col("stem").rlike(plate), F.struct(F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract("stem", plate, 1))), F.lit("UNKNOWN")).alias("type"), F.regexp_extract("stem", plate, 2).alias("rest"))).otherwise(picture).alias("p"))
    seen = seen.filter("p.type is not null").select("path", spoken(F.col("p.rest")).alias("name"), F.col("p.type").alias("entity_type"))

    page = _started(F.col("stem"), PAGES)
    lines = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 2)
    plain = lambda x: F.trim(F.regexp_replace(x, "^[# ]+", ""))
    one, two = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    shown = F.regexp_extract(plain(one), r"^!\[(.*?)\]", 1)
    heading = F.when(shown != "", F.trim(shown)).when(one.startswith("#"), plain(one)).when(two.startswith("#"), plain(two))
    heading = F.trim(F.regexp_replace(heading, r"(?i)\s*\((?:faction|character|conflict|location|place)\)", ""))
    fields = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*\|+[ \t]*([^|\n]*[^|\s])")), lambda x: F.lower(x))
    typed = F.create_map(*[F.lit(x) for t, fs in BOX.items() for f in fs for x in (f, t)])
    boxed = F.get(F.filter(F.transform(fields, lambda f: F.try_element_at(typed, f)), lambda t: t.isNotNull()), F.lit(0))
    wiki = rows.filter("folder = 'wiki' and format = 'md'").select("path", page.alias("p"), "stem", heading.alias("heading"), boxed.alias("boxed"))
    wiki = wiki.select("path", spoken(F.coalesce("p.rest", "stem")).alias("own"), "heading", F.coalesce("p.type", "boxed").alias("told")).withColumn("heading", F.coalesce(F.nullif("heading", F.lit("")), "own"))
    known = _short(seen).groupBy("name").agg(F.min_by("entity_type", "path").alias("t"))
    wiki = wiki.join(known.select(F.col("name").alias("heading"), F.col("t").alias("a")), "heading", "left").join(known.select(F.col("name").alias("own"), F.col("t").alias("b")), "own", "left")
    wiki = wiki.select("path", F.explode(F.array_distinct(F.array("heading", "own"))).alias("name"), F.coalesce("a", "b", "told", F.lit("UNKNOWN")).alias("entity_type"))

    codex = rows.filter("folder = 'codex' and format = 'pdf'").select("path", spoken(F.col("stem")).alias("name"), F.lit("DOCUMENT").alias("entity_type"))
    every = codex.withColumn("turn", F.lit(0)).unionByName(_short(wiki).withColumn("turn", F.lit(1))).unionByName(_short(seen).withColumn("turn", F.lit(2)))
    return every.filter("name <> ''").groupBy("name").agg(F.min_by("entity_type", F.struct("turn", "path")).alias("entity_type"))


def _short(names: DataFrame) -> DataFrame:
    """Names that begin with "the" also without it."""
    both = F.when(F.lower("name").startswith("the "), F.array("name", F.substring("name", F.lit(5), F.length("name")))).otherwise(F.array("name"))
    return names.withColumn("name", F.explode(both))


def entities_of(texts: DataFrame, forms: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """(key, name, entity_type, mentions, n, source, confidence): the entities of each text, by the forms (form, name, entity_type) of a gazette.

    Matches of several forms of one name are one entity: ``mentions`` are the forms that stand in the text (sorted), ``n`` how often they do together.
    Forms of less than two characters or of digits only mean nobody; a form of several names means the first, null forms and names none.
    """
    usable = forms.filter("form is not null and name is not null").withColumn("said", F.trim("form")).filter("length(said) >= 2 and not said rlike '^[0-9]+$'")
    found = gazette_matches(texts, usable.select(F.col("said").alias("name")), key, text, most).withColumnRenamed("name", "said")
    about = usable.groupBy("said").agg(F.min(F.struct("name", "entity_type")).alias("e"))
    met = found.join(about, "said").select(key, "said", "n", "e.*")
    # the forms of a name in one text are few: as many as it has
    return met.groupBy(key, "name").agg(F.min("entity_type").alias("entity_type"), F.array_join(F.array_sort(F.collect_set("said")), "|").alias("mentions"), F.sum("n").alias("n")).withColumn("source", F.lit("gazette")).withColumn("confidence", F.lit(1.0))


#: Names of more letters are compared by their thirds instead of by what is left without one or two letters.
LONG = 48
#: Rows of forms and links that are settled in one task; more are made fewer by rounds first. Cost only.
AT_ONCE = 2_000_000
_BASE, _MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, key): hashes of what is left of each string without up to two of its letters: a polynomial over the letters, as differences of prefix sums."""
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    for x in batches:
        said = x.column("x").to_pylist()
        length = np.array([len(t) for t in said], np.int64)
        for size in np.unique(length).tolist():
            i, j = np.triu_indices(size, 1)
            every, one = np.flatnonzero(length == size), np.arange(size)
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            step = max(1, 1_000_000 // (1 + size + len(i)))
            for at in (every[k : k + step] for k in range(0, len(every), step)):
                letters = np.frombuffer("".join(said[k] for k in at).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
                mixed = (letters + np.uint64(1)) * np.uint64(_MIX)
                sums = np.zeros((len(at), size + 1), np.uint64)
                np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers, axis=1, out=sums[:, 1:])
                whole = sums[:, -1:]
                keys = np.concatenate([whole, sums[:, one] + back * (whole - sums[:, one + 1]), sums[:, i] + back * (sums[:, j] - sums[:, i + 1] + back * (whole - sums[:, j + 1]))], axis=1)
                keys.sort(axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                row, column = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([x.column("x").take(pa.array(at[row])).cast(pa.string()), pa.array(keys[row, column].view(np.int64))], ["x", "key"])


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): strings with a key in common, in a stream of (x, key) sorted by key."""

    def pairs(key, said):
        at, step = np.arange(len(key)), 1
        while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([said.take(pa.array(part)), said.take(pa.array(part + step))], ["a", "b"])
            step += 1

    keys, said = np.empty(0, np.int64), pa.array([], pa.string())
    for x in batches:
        keys, said = np.concatenate([keys, x.column("key").to_numpy()]), pa.concat_arrays([said, x.column("x").cast(pa.string())])
        if len(keys):
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield from pairs(keys[:last], said.slice(0, last))
            keys, said = keys[last:], said.slice(last)
    yield from pairs(keys, said)


def near_names(names: DataFrame, name: str = "core") -> DataFrame:
    """(a, b): the pairs of different strings, a < b, of at least five letters each, that one to two edits apart (Levenshtein).

    Strings two edits apart at most have a common rest after at most two letters are left out of each, so they are joined on their rests:
    only strings that are near each other share any, however often a family name comes. Beyond ``LONG`` letters, where rests are many,
    one third of the one stands unchanged in the other, at most two places aside. Each pair is verified once; no pair is lost.
    """
    rows = names.select(F.col(name).alias("x")).filter("length(x) >= 5").distinct()
    spark = names.sparkSession
    keys = rows.filter(F.length("x") <= LONG + 2).repartition(width(spark)).mapInArrow(_rests, "x string, key long")
    met = keys.repartition(width(spark), "key").sortWithinPartitions("key").mapInArrow(_sharing, "a string, b string")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    third = lambda n, i, d: f"substring(x, int(({i} * {n}) div 3) + 1 + {d}, int((({i} + 1) * {n}) div 3) - int(({i} * {n}) div 3))"
    wide = rows.filter(F.length("x") > LONG)
    own = wide.select(F.col("x").alias("a"), F.explode(F.expr(f"transform(sequence(0, 2), i -> struct(length(x) AS n, i AS i, {third('length(x)', 'i', '0')} AS said))")).alias("k"))
    aside = f"transform(sequence(-2, 2), d -> struct(n AS n, i AS i, {third('n', 'i', 'd')} AS said))"
    there = wide.select(F.col("x").alias("b"), F.explode(F.expr(f"array_distinct(flatten(transform(sequence(length(x) - 2, length(x) + 2), n -> flatten(transform(sequence(0, 2), i -> {aside})))))")).alias("k"))
    long = own.join(there, "k").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(long).distinct().filter("abs(length(a) - length(b)) <= 2 and levenshtein(a, b, 2) between 1 and 2")


def resolved(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, canonical): which name stands for each different one: of names in order each means the first one before it that stands for itself and is
    the same in any case, has the same core, or a core of at least five letters at most two edits away; else it stands for itself.

    First come the names of the gazette ``known`` (name), those with "the" last, shorter ones first; then those of the best source, shorter ones first;
    ties go by name. Null and blank names are left out. The order is kept by rounds: a name is settled as soon as all names before it that are near are,
    or one of them stands for itself. What is few enough for one task is settled there, in order, without further rounds.
    """
    own = mentions.select(F.trim("name").alias("name"), source_rank(F.col("source")).alias("r")).filter("name <> ''").groupBy("name").agg(F.max("r").alias("r"))
    names = own.select("name", F.struct(F.lit(1).alias("turn"), (-F.col("r")).alias("late"), F.length("name").alias("size"), "name").alias("place"))
    known = names.select("name").limit(0) if known is None else known
    seeds = known.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    seeds = seeds.select("name", F.struct(F.lit(0).alias("turn"), F.lower("name").startswith("the ").cast("int").alias("late"), F.length("name").alias("size"), "name").alias("place"))
    rows = names.unionByName(seeds).withColumn("core", F.lower(core_name(F.col("name"))))
    # what two names must share to be the same or to have the same core; names alike share one, so near cores link these and not all of their names
    both = F.array(F.concat(F.lit("n"), F.lower("name")), F.when(F.col("core") != "", F.concat(F.lit("c"), "core")))
    forms = cut(rows.select("name", "place", F.explode(both).alias("form")).filter("form is not null"))
    links = near_names(forms.filter("form like 'c%'").select(F.substring("form", F.lit(2), F.length("form")).alias("core"))).select(F.concat(F.lit("c"), "a").alias("a"), F.concat(F.lit("c"), "b").alias("b"))
    same = forms.select(F.col("form").alias("a"), F.col("form").alias("b")).distinct()
    near = cut(same.unionByName(links).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    first = lambda df, n: near.join(df.groupBy(F.col("form").alias("b")).agg(F.min("place").alias(n)), "b").groupBy(F.col("a").alias("form")).agg(F.min(n).alias(n))
    settled, heads, left = None, forms.filter("place.turn = 0"), forms.filter("place.turn = 1")
    while True:
        links = near.join(left.select(F.col("form").alias("a")).distinct(), "a", "left_semi")
        above = heads.groupBy("form").agg(F.min("place").alias("place")).join(links.select(F.col("b").alias("form")).distinct(), "form", "left_semi")
        place, none = [f"place.{c} AS {c}" for c in ("late", "size", "turn", "name")], [f"cast(null AS {t}) AS {c}" for t, c in (("int", "late"), ("int", "size"), ("int", "turn"), ("string", "name"))]
        known = left.selectExpr("0 AS kind", "form", "cast(null AS string) AS other", *place).unionByName(above.selectExpr("1 AS kind", "form", "cast(null AS string) AS other", *place)).unionByName(links.selectExpr("2 AS kind", "a AS form", "b AS other", *none))
        known = cut(known)
        if known.count() <= AT_ONCE:
            done = known.coalesce(1).mapInArrow(_settled, "name string, canonical string")
            return done if settled is None else settled.select("name", "canonical").unionByName(done)
        # around each name the first that stands for itself and the first that isn't settled; the name itself is one of these
        view = left.join(first(left, "open"), "form").join(first(heads, "head"), "form", "left").groupBy("name", "place").agg(F.min("open").alias("open"), F.min("head").alias("head"))
        done = view.filter("head < open or open = place").select("name", F.when(F.col("head") < F.col("open"), F.col("head.name")).otherwise(F.col("name")).alias("canonical"), (F.coalesce(F.col("head") >= F.col("open"), F.lit(True))).alias("itself"))
        settled = cut(done if settled is None else settled.unionByName(done))
        heads = forms.filter("place.turn = 0").unionByName(forms.filter("place.turn = 1").join(settled.filter("itself").select("name"), "name", "left_semi"))
        left = cut(forms.filter("place.turn = 1").join(settled.select("name"), "name", "left_anti"))
        if left.isEmpty():
            return settled.select("name", "canonical")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, canonical) of the names that are left: their forms (kind 0), the first that stands for itself of each form near them (1), links of forms (2)."""
    forms: dict[tuple, list[str]] = {}
    first: dict[str, tuple] = {}
    near: dict[str, list[str]] = {}
    for x in batches:
        for kind, form, other, *place in zip(*(x.column(c).to_pylist() for c in ("kind", "form", "other", "turn", "late", "size", "name")), strict=True):
            if kind == 0:
                forms.setdefault(tuple(place), []).append(form)
            elif kind == 1:
                first[form] = tuple(place)
            else:
                near.setdefault(form, []).append(other)
    names, canonical = [], []
    for place in sorted(forms):
        head = min((first[b] for a in forms[place] for b in near.get(a, ()) if b in first), default=place)
        if head >= place:
            head = place
            for a in forms[place]:
                first[a] = min(first.get(a, place), place)
        names.append(place[-1])
        canonical.append(head[-1])
    for i in range(0, len(names), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000], pa.string()) for c in (names, canonical)], ["name", "canonical"])
