"""Evaluation passages inside training texts, found through a distributed positional inverted index.

The index is partitioned by documents: a shard holds some documents laid one after the other on one
axis of positions, and for every term the sorted list of its positions. It is stored in the shared
folder and can be searched again. A search takes the passages to every shard. For each
window of a passage the lists are intersected from the rarest term on, every list shifted by the
term's offset in the window: what is left are the places where the whole window stands (exact
phrase), or, with a slop, where its terms stand at most that far from their places (proximity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.near_duplicates import words
from archivolt.plans.session import cut

#: Passages are taken to the shards in blocks of at most about this many words.
BLOCK_WORDS = 500_000
#: Free positions between two documents of a shard, so that no match crosses them.
GAP = 64

INDEX = "shard long, term long, places array<int>, docs array<long>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index: a row per shard and term (shard, term, places), and one per shard with its documents.

    Texts that are null, empty or without a word are in no shard. A repeated id is indexed with each of its texts.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        for x in batches:
            lists = x.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            if not sizes.sum():
                continue
            terms = lists.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes[:-1] + GAP)])
            place = np.arange(len(terms), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
            order = np.argsort(terms, kind="stable")
            terms, place = terms[order], place[order].astype(np.int32)
            edge = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1], [True]]))
            k = len(edge) - 1
            posting = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(place))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None], pa.int64()), pa.array([starts.astype(np.int32)]), pa.array([x.column("key").to_numpy()])], ["shard", "term", "places", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard)), pa.array(terms[edge[:-1]]), posting, pa.nulls(k, pa.list_(pa.int64()))], ["shard", "term", "places", "docs"])
            shard += 1

    terms = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    rows = docs.select(F.col(key).cast("long").alias("key"), terms.alias("terms")).filter("key is not null and size(terms) > 0")
    return cut(rows.mapInArrow(build, INDEX))


def _find(lists: dict[int, np.ndarray], window: list[int], least: int, slop: int) -> np.ndarray:
    """The positions (of the window's start) at which at least ``least`` of its terms stand at most ``slop`` from their places."""
    have = sorted((len(lists[t]), o) for o, t in enumerate(window) if t in lists)
    if len(have) < least:
        return np.empty(0, np.int64)
    spare = len(window) - least  # terms that may be missing: any of the rarest spare + 1 may be the one to start from
    starts = [lists[window[o]].astype(np.int64) - o for _, o in have[: spare + 1 - (len(window) - len(have))]]
    found = starts[0] if len(starts) == 1 else np.unique(np.concatenate(starts))
    misses = np.full(len(found), len(window) - len(have))
    for _, o in have:
        if not len(found):
            break
        places = lists[window[o]]
        near = np.searchsorted(places, found + (o - slop))
        there = (near < len(places)) & (places[np.minimum(near, len(places) - 1)] <= found + (o + slop))
        misses += ~there
        kept = misses <= spare
        found, misses = found[kept], misses[kept]
    return found


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", run: int = 10, least: int | None = None, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, words, place): every document with a passage of every item, with the longest passage's number of
    words and its first place (in words, from 0) in the document.

    A passage is ``run`` consecutive words of the item, standing in the document in the same order and together. With ``least``
    below ``run`` or a ``slop``, only so many of the words must be there, each at most ``slop`` places off.
    Items with fewer than ``run`` words, null or empty texts match nothing. Equal documents each get their rows.
    """
    spark = index.sparkSession
    least = run if least is None else least
    terms = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    stated = cut(items.select(F.col(key).cast("long").alias("item"), terms.alias("terms")).filter(F.size("terms") >= run).distinct())
    total = stated.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        block = stated.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # BLOCK_WORDS words, about
        part = _search(index, [(r.item, list(r.terms)) for r in block], run, least, slop)
        found = part if found is None else found.unionByName(part)
    # an item's text may come in several rows: the longest passage
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("place")).alias("back"))).alias("m")).select("doc_id", "item_id", "m.words", (-F.col("m.back")).alias("place"))


def _search(index: DataFrame, items: list[tuple[int, list[int]]], run: int, least: int, slop: int) -> DataFrame:
    asked = index.sparkSession.sparkContext.broadcast((items, {t for _, terms in items for t in terms}))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, wanted = asked.value
        known = np.array(sorted(wanted), np.int64)
        shard, lists, docs, starts = None, {}, None, None
        for x in batches:
            shards, terms, places, names = x.column("shard").to_numpy(), x.column("term"), x.column("places"), x.column("docs")
            number = terms.fill_null(0).to_numpy()
            want = np.isin(number, known) | terms.is_null().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(want):
                if shards[i] != shard:
                    if lists:
                        yield from hits(items, lists, docs, starts)
                    shard, lists = shards[i], {}
                if terms[i].is_valid:
                    lists[int(number[i])] = places[i].values.to_numpy()
                else:
                    docs, starts = names[i].values.to_numpy(), places[i].values.to_numpy()
        if lists:
            yield from hits(items, lists, docs, starts)

    def hits(items, lists, docs, starts):
        rows: list[tuple[np.ndarray, ...]] = []
        for item, terms in items:
            at, window = [], []
            for a in range(len(terms) - run + 1):
                found = _find(lists, terms[a : a + run], least, slop)
                if len(found):
                    at.append(found - a)
                    window.append(np.full(len(found), a))
            if at:
                # windows that follow each other on one diagonal make one passage
                d, w = np.concatenate(at), np.concatenate(window)
                order = np.lexsort((w, d))
                d, w = d[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1] + 1)]))
                last = np.concatenate([first[1:], [len(d)]]) - 1
                place = d[first] + w[first]
                doc = np.searchsorted(starts, place, side="right") - 1
                doc = np.maximum(doc, 0)
                rows.append((docs[doc], np.full(len(first), item), w[last] - w[first] + run, np.maximum(place - starts[doc], 0)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "words", "place"])

    return index.mapInArrow(look, "doc_id long, item_id long, words long, place long")


def leaks(docs: DataFrame, items: DataFrame, run: int = 10) -> DataFrame:
    """(doc_id, item_id, words, place) of the passages of at least ``run`` consecutive words; see ``search``."""
    return search(build_index(docs), items, run=run)
