"""Text expressions, all built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of lexical queries.
STOP_WORDS = (
    "what is the in of to a an and or for on at by with from as about into through during before after which who whom whose "
    "where when why how did does do according per official recorded known called named"
).split()
# Fixed value: the name space of the entity ids (the DNS name space of RFC 4122) and their prefix.
NAMESPACE, ENTITY_PREFIX = "6ba7b8109dad11d180b400c04fd430c8", "ashen_era:entity:"


def token_count(text: Column) -> Column:
    """The approximate number of tokens: 1.3 for every word between white space, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"))) * F.lit(1.3)).cast("int"))


def tokens(text: Column) -> Column:
    """The runs of letters and digits of any script, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def plain_or_tokens(text: Column) -> tuple[Column, Column]:
    """The two columns that ``words_of`` reads: a text of ASCII as it stands, and the ``tokens`` of others."""
    ascii_ = F.length(text) == F.octet_length(text)
    return F.when(ascii_, text).alias("plain"), F.when(~ascii_, tokens(text)).alias("w")


#: Letters and digits of ASCII in lower case, all else as 0.
_LOWER = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 0 for c in range(256))


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Of a batch with ``plain_or_tokens``: rows, their numbers of words, and these words in order, as ``tokens`` has them: first of the texts of ASCII, then of the others."""
    plain, w = batch.column("plain"), batch.column("w")
    rows = np.flatnonzero(pc.is_valid(plain).to_numpy(zero_copy_only=False))
    if len(rows):
        texts = plain.take(pa.array(rows)).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(rows) + 1]
        data = np.frombuffer(bytes(texts.buffers()[2] or b"")[: ends[-1]].translate(_LOWER), np.uint8)
        inside = data != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < ends[1:]]  # a word ends with its text
        begins[first] = inside[first]
        at = np.flatnonzero(begins)
        offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        yield rows, np.diff(np.searchsorted(at, ends)), words
    rows = np.flatnonzero(pc.is_valid(w).to_numpy(zero_copy_only=False))
    if len(rows):
        some = w.take(pa.array(rows))
        yield rows, pc.list_value_length(some).to_numpy(zero_copy_only=False).astype(np.int64), some.flatten().cast(pa.string())


def query_terms(text: Column) -> Column:
    """The different terms of a question that are worth looking up."""
    return F.array_distinct(F.filter(tokens(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2)))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name in a name space given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def entity_id(name: Column) -> Column:
    return uuid5(F.concat(F.lit(ENTITY_PREFIX), F.lower(F.trim(name))))


def core_name(name: Column) -> Column:
    """A name without one leading title, an epithet and a place of origin."""
    x = F.regexp_replace(F.trim(name), r"(?i)^(ser|lord|lady|high|the)\s+", "")
    x = F.regexp_replace(x, r"(?i)\s+the\s+\S+$", "")
    return F.trim(F.regexp_replace(x, r"(?i)\s+of\s+(the\s+)?\S+(\s+\S+)?$", ""))


def title_of(stem: Column) -> Column:
    """A file's stem as a title."""
    return F.initcap(F.trim(F.regexp_replace(stem, "[_-]+", " ")))


def pronouns(text: Column) -> Column:
    """How many pronouns of the third person a text has."""
    return F.regexp_count(text, F.lit(r"(?i)\b(he|she|they|it|his|her|their|him|them)\b"))
