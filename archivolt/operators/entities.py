"""Entities: gazette matches, candidates, aggregation of mentions, aliases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import entity_id, plain_or_tokens, words_of

# How much a source of mentions is trusted.
SOURCE_RANK = {"gazette": 3, "gemini_ner": 2, "rules": 1, "unknown": 0}


def source_rank(source: Column) -> Column:
    pairs = [F.lit(x) for kv in SOURCE_RANK.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(0))


#: Bits of the bitmap of names (its logarithm) that spares looking up most runs of words. Its size influences cost, never the result.
BITS = 25


def _hashed(words: pa.Array) -> np.ndarray:
    """A hash of each word; a word that comes again is hashed once."""
    coded = words.cast(pa.binary()).dictionary_encode()
    known = np.fromiter(map(crc32, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return (known * np.uint64(0xD6E8FEB86659FD93))[coded.indices.to_numpy()]


def _runs(length: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words up to ``most``: it, and the text, the place among all words of the batch and the bit of each run of so many words; ``length``: the texts' numbers of words, ``words``: these as hashes."""
    text = np.repeat(np.arange(len(length)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(words))  # words from each place to the end of its text
    at, run = np.arange(len(words)), np.zeros(len(words), np.uint64)
    for size in range(1, most + 1):
        here = left[at] >= size
        at, run = at[here], run[here]
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[at + size - 1]
        yield size, text[at], at, ((run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmap(known: DataFrame, most: int) -> np.ndarray:
    """The bits of all names (said, size), as bytes."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            length = x.column("size").to_numpy().astype(np.int64)
            for size, text, _, bit in _runs(length, _hashed(x.column("w").flatten()), most):
                yield pa.RecordBatch.from_arrays([pa.array(bit[length[text] == size] + 1)], ["bit"])

    # counted from one, so that a bit's number in its bucket is the rest
    rows = known.select(F.split("said", " ").alias("w"), "size").mapInArrow(bits, "bit long")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return out


@dataclass(frozen=True)
class Gazette:
    """Names (said, name, size) as they are looked up, and the bitmap of them: made once for several tables of texts."""

    known: DataFrame
    bits: Broadcast
    most: int


def gazette(names: DataFrame, most: int = 4, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Gazette:
    """Of a column ``name`` those of up to ``most`` words; ``keep``: what stores them, if they are to be used more than once."""
    known = names.select(F.array_join(F.array_remove(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), ""), " ").alias("said"), "name").filter("said <> ''").groupBy("said").agg(F.min("name").alias("name"), (F.size(F.split("said", " "))).alias("size")).filter(F.col("size") <= most)
    known = keep(known)
    return Gazette(known, names.sparkSession.sparkContext.broadcast(_bitmap(known, most)), most)


def gazette_matches(texts: DataFrame, names: DataFrame | Gazette, key: str, text: str, most: int = 4) -> DataFrame:
    """(key, name, n): how often each name of the gazette (a column ``name``) stands in each text, by words, in any case.

    Every run of up to ``most`` words is looked up; of matches that overlap the longest stands, then the first.
    Names that are null or longer aren't found. The gazette is joined on equality, so it may be of any size; runs that no name can equal by a
    bitmap of fixed size aren't written out for the join.
    """
    held = names if isinstance(names, Gazette) else gazette(names, most)
    known, bits, most = held.known, held.bits, held.most
    rows = texts.select(F.col(key).alias("key"), *plain_or_tokens(F.col(text))).filter("plain is not null or w is not null")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row, length, words in words_of(x):
                begins = np.cumsum(length) - length
                for size, text, at, bit in _runs(length, _hashed(words), most):
                    here = np.flatnonzero(bits.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    text, at = text[here], at[here]
                    said = pc.binary_join_element_wise(*[words.take(pa.array(at + i)) for i in range(size)], " ")
                    yield pa.RecordBatch.from_arrays([x.column("key").take(pa.array(row[text])), pa.array((at - begins[text]).astype(np.int32)), said], ["key", "at", "said"])

    grams = rows.mapInArrow(looked_up, f"key {dict(rows.dtypes)['key']}, at int, said string")
    hits = grams.join(known, "said")
    # a hit goes if a longer one, or one as long that begins earlier, covers part of it
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("long"), "at", "size", "name"))).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda a, x: F.when(F.exists(a, lambda y: (y["at"] < x["at"] + x["size"]) & (x["at"] < y["at"] + y["size"])), a).otherwise(F.array_append(a, x)))
    return spans.select("key", F.explode(kept).alias("m")).groupBy(F.col("key").alias(key), F.col("m.name").alias("name")).agg(F.count("*").alias("n"))


def capitalised(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): capitalised words of all texts and how often they stand there."""
    return texts.select(F.explode(F.filter(F.split(F.col(text), r"[ \n]+"), lambda w: w.rlike("^[A-Z][a-z]+$"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with a name, once each, with the id of what they name."""
    return mentions.filter("name is not null and trim(name) <> ''").dropDuplicates(["mention_id"]).withColumn("id", entity_id(F.col("name")))


def aggregated(mentions: DataFrame) -> DataFrame:
    """One row per entity: its name (that of the best source, then the first mention), type, source, highest confidence, number of mentions, different chunks, and sorted aliases."""
    rows = distinct_mentions(mentions).withColumn("rank", source_rank(F.col("source")))
    best = F.struct(-F.col("rank"), "mention_id")
    known = F.when(F.coalesce("entity_type", F.lit("UNKNOWN")) != "UNKNOWN", F.col("entity_type"))
    one = rows.groupBy("id").agg(
        F.min_by("name", best).alias("name"),
        F.coalesce(F.min_by(known, F.when(known.isNotNull(), best)), F.lit("UNKNOWN")).alias("entity_type"),
        F.min_by("source", best).alias("source"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("mention_count"),
        F.count_distinct("chunk_id").alias("chunks"),
    )
    said = rows.select("id", F.explode("mentions").alias("alias")).filter("alias is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))
    return one.join(said, "id", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


def links(mentions: DataFrame) -> DataFrame:
    """(id, chunk_id, document_id): where each entity is mentioned."""
    return distinct_mentions(mentions).filter("chunk_id is not null").select("id", "chunk_id", "document_id").distinct()


def with_aliases(entities: DataFrame, table: DataFrame) -> DataFrame:
    """(entity_id, name, aliases): ``entities`` with the aliases of a table (alias, canonical) of names added; blank ones and names without an entity are left out."""
    clean = table.select(F.trim("alias").alias("alias"), F.lower(F.trim("canonical")).alias("said")).filter("alias <> '' and said <> '' and upper(said) <> 'UNKNOWN_ALIAS'")
    more = clean.groupBy("said").agg(F.array_sort(F.collect_set("alias")).alias("more"))
    rows = entities.withColumn("said", F.lower(F.trim("name"))).join(more, "said", "left")
    every = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select("entity_id", "name", every.alias("aliases"))


def looked_up(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(asked, entity_id, exact): for each different name the entity that bears it, by name before by alias, then the one mentioned most, then the smallest id."""
    every = entities.select("entity_id", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.explode(F.concat(F.array(F.struct(F.lower("name").alias("said"), F.lit(1).alias("exact"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("said"), F.lit(0).alias("exact"))))).alias("s"))
    forms = every.select("entity_id", "mention_count", "s.said", "s.exact").filter("said is not null")
    best = forms.groupBy("said").agg(F.min_by(F.struct("entity_id", "exact"), F.struct(-F.col("exact"), -F.col("mention_count"), "entity_id")).alias("b"))
    asked = names.select(F.col("name").alias("asked")).filter("asked is not null").distinct().withColumn("said", F.lower("asked"))
    return asked.join(best, "said").select("asked", "b.entity_id", (F.col("b.exact") == 1).alias("exact"))
