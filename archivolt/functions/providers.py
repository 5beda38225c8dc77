"""What models would do, with deterministic stand-ins that need none.

``embedded`` and ``scored`` take a function in place of their default: one that maps pandas series to another
(run as a pandas UDF, so that a model is loaded once per worker); ``composed`` takes one of DataFrames. ``cached`` calls a provider only for what a cache lacks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from hashlib import md5
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import query_terms, tokens


#: Letters and digits of ASCII in lower case, all else as spaces.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Hashes of words and pairs of words that a worker has met; bounded, as words come again.
_HASHES: dict[bytes, int] = {}


def _words(text: str | None) -> list[bytes]:
    """The runs of letters and digits, lower-cased."""
    text = text or ""
    if text.isascii():
        return text.encode().lower().translate(_PLAIN).split()
    return [w.encode() for w in re.findall(r"[^\W_]+", text.lower())]


def _hash(gram: bytes) -> int:
    if gram not in _HASHES:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        _HASHES[gram] = int.from_bytes(md5(gram).digest()[:4])
    return _HASHES[gram]


def hashed_vectors(texts: list[str | None], size: int, before: list[str | None] | None = None) -> list[np.ndarray]:
    """Counts of words and pairs of words, hashed to ``size`` cells with signs: of the texts, and if there are texts to stand before them, of both as one, too.

    A word or pair is hashed once for all texts."""
    own = [_words(t) for t in texts]
    words = own if before is None else [_words(b) + w for b, w in zip(before, own, strict=True)]
    size_of = lambda x: np.fromiter(map(len, x), np.int64, len(x))
    length, flat = size_of(words), [w for x in words for w in x]
    number: dict[bytes, int] = defaultdict(count().__next__)
    code = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    known = list(number)
    text = np.repeat(np.arange(len(words)), length)
    spot = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    two = np.flatnonzero(text[:-1] == text[1:])
    pairs, pair = np.unique(code[two] * len(known) + code[two + 1], return_inverse=True)
    one = np.fromiter(map(_hash, known), np.int64, len(known))[code]
    both = np.fromiter((_hash(known[p // len(known)] + b" " + known[p % len(known)]) for p in pairs.tolist()), np.int64, len(pairs))[pair]
    h, text, spot = np.concatenate([one, both]), np.concatenate([text, text[two]]), np.concatenate([spot, spot[two]])
    cell, sign = text * size + h % size, np.where(h >> 31, 1.0, -1.0)
    sums = lambda at: np.bincount(cell[at], sign[at], len(words) * size).reshape(-1, size).astype(np.float32)
    if before is None:
        return [sums(slice(None))]
    return [sums(spot >= (length - size_of(own))[text]), sums(slice(None))]


def embedded(text: Column, size: int = 64, provider: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """The vector of a text; texts without words have a zero vector."""

    def run(texts: pd.Series) -> pd.Series:
        return provider(texts) if provider else pd.Series(list(hashed_vectors(list(texts), size)[0]))

    return F.pandas_udf(run, "array<float>")(text)


def scored(question: Column, text: Column, provider: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> Column:
    """How well a text answers a question: by the provider, or the share of the question's terms that the text holds: the offline reranker, without leaving the JVM."""
    if provider:
        return F.pandas_udf(lambda q, t: provider(q, t), "double")(question, text)
    terms = query_terms(question)
    return F.round(F.size(F.array_intersect(terms, tokens(text))) / F.greatest(F.size(terms), F.lit(1)), 6)


def composed(contexts: DataFrame, most: int = 2, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, answer): by the provider, or the offline generator: of a question's evidence (qid, question, evidence_id, seq, content) the sentences that
    share most of its terms, each cited. Only ``most`` of them are gathered for each question."""
    if provider:
        return provider(contexts).select("qid", "answer")
    said = contexts.select("qid", "question", "evidence_id", "seq", F.posexplode(F.split("content", r"(?<=[.!?])\s+")).alias("at", "sentence")).filter("length(sentence) > 10")
    best = said.withColumn("score", scored(F.col("question"), F.col("sentence"))).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "seq", "at"))
    top = best.withColumn("place", place).filter(F.col("place") <= most)
    line = F.concat("sentence", F.lit(" ["), "evidence_id", F.lit("]"))
    return top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x.line), " ").alias("answer"))


def cached(rows: DataFrame, cache: DataFrame, text: str, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with ``value`` from a cache (hash, value) of the texts' SHA-256, or from the provider: it is given (hash, text), each text once,
    and returns (hash, value)."""
    keyed = rows.withColumn("hash", F.sha2(F.col(text), 256))
    missing = keyed.select("hash", F.col(text).alias("text")).filter("hash is not null").join(cache, "hash", "left_anti").dropDuplicates(["hash"])
    return keyed.join(cache.select("hash", "value").unionByName(provider(missing).select("hash", "value")), "hash", "left").drop("hash")
