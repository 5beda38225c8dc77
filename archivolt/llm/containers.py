"""Documents packed into containers of a fixed number of tokens, neighbours on a space-filling curve together.

Each text's tokens are hashed into a vector of counts, which is projected to a few dimensions; the place of the
projection on a Hilbert curve through them is the document's key. Documents are range-sorted by key over the
cluster and packed along the curve, a short stretch at a time: within a stretch the largest first, each into the fullest
container it fits, with a few containers left open by the stretches before. A text is split only if it alone exceeds a
container: into full containers and a rest that is packed like any other.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.plans.session import cut, width

#: Vocabulary of a public tokenizer, and the published pattern that divides texts for it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CELLS, DIMENSIONS, BITS = 512, 4, 12
#: Items of a stretch of the curve, and containers that stay open from one to the next: short, so that what is packed together are neighbours.
STRETCH, OPEN = 64, 32
#: Containers with less room than any item of use are closed.
TIGHT = 2

_loaded: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    """The tokenizer of a vocabulary file, once per process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The places on the Hilbert curve of integer points (rows) of less than 2 ** bits in every dimension."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the smaller cubes
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measured(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """(key, tokens, at): each text's number of tokens and its projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        planes = np.random.default_rng(11).standard_normal((CELLS, DIMENSIONS))
        for x in batches:
            if not x.num_rows:
                continue
            table, sizes = np.zeros((x.num_rows, CELLS)), np.zeros(x.num_rows, np.int64)
            for i, t in enumerate(x.column("text").to_pylist()):
                ids = np.array(encode(t), np.int64)
                sizes[i] = len(ids)
                if len(ids):
                    table[i] = np.bincount(ids * 2654435761 % 4294967296 * CELLS >> 32, minlength=CELLS)
            table = np.sqrt(table)
            table /= np.maximum(np.linalg.norm(table, axis=1), 1e-9)[:, None]
            at = pa.ListArray.from_arrays(pa.array(np.arange(x.num_rows + 1) * DIMENSIONS, pa.int32()), pa.array((table @ planes).ravel()))
            yield pa.RecordBatch.from_arrays([x.column("key"), pa.array(sizes), at], ["key", "tokens", "at"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return rows.mapInArrow(run, "key long, tokens long, at array<double>")


def _keyed(batches: Iterator[pa.RecordBatch], middle: list[float], spread: list[float]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if x.num_rows:
            at = x.column("at").flatten().to_numpy().reshape(-1, DIMENSIONS)
            cell = ((np.tanh((at - middle) / spread * 0.8) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([x.column("key"), x.column("tokens"), pa.array(hilbert(cell, BITS))], ["key", "tokens", "curve"])


def _pack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    return _packed(batches, capacity, TaskContext.get().partitionId() << 40)


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, base: int) -> Iterator[pa.RecordBatch]:
    """Containers, numbered from ``base``, for a stream of items in the order of the curve."""
    number = 0
    rooms: list[tuple[int, int]] = []  # (free tokens, container), by free tokens
    out: list[tuple[int, int, int, int]] = []

    def stretch(items: list[tuple[int, int]]) -> None:
        nonlocal number, rooms
        rest: list[tuple[int, int, int]] = []
        for k, n in items:
            for start in range(0, n - capacity + 1, capacity):
                out.append((k, base + number, start, capacity))
                number += 1
            if n % capacity or not n:
                rest.append((n % capacity, k, n - n % capacity))
        rest.sort(key=lambda x: -x[0])
        for size, k, start in rest:
            i = bisect_left(rooms, (size, -1))
            if i < len(rooms):
                free, container = rooms.pop(i)
            else:
                free, container = capacity, number
                number += 1
            out.append((k, base + container, start, size))
            if free - size >= TIGHT:
                insort(rooms, (free - size, container))
        rooms = rooms[-OPEN:]  # the emptiest

    def batch() -> pa.RecordBatch:
        columns = [pa.array(v, pa.int64()) for v in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "container", "start_token", "tokens"])

    held: list[tuple[int, int]] = []
    for x in batches:
        held += zip(x.column("key").to_pylist(), x.column("tokens").to_pylist(), strict=True)
        whole = len(held) // STRETCH * STRETCH
        for i in range(0, whole, STRETCH):
            stretch(held[i : i + STRETCH])
        held = held[whole:]
        if out:
            yield batch()
    if held:
        stretch(held)
        yield batch()


def containers(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, container, start_token, tokens): the pieces of each text (one, unless it exceeds a container) with their containers.

    No container holds more than ``capacity`` tokens. Empty texts take no room but get a container; null texts have no row.
    Equal texts are neighbours. A repeated id is packed with each of its texts. Other columns are not read.
    """
    spark = docs.sparkSession
    items = cut(measured(docs, key, text, path, pattern))
    stats = items.agg(*[f(F.col("at")[i]).alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    middle = [stats[f"m{i}"] or 0.0 for i in range(DIMENSIONS)]
    spread = [stats[f"s{i}"] or 1.0 for i in range(DIMENSIONS)]
    keyed = items.mapInArrow(partial(_keyed, middle=middle, spread=spread), "key long, tokens long, curve long")
    # by the key and, as very many texts may have one key, by the id
    along = keyed.repartitionByRange(width(spark), "curve", "key").sortWithinPartitions("curve", "key")
    packed = along.mapInArrow(partial(_pack, capacity=capacity), "key long, container long, start_token long, tokens long")
    return packed.withColumnRenamed("key", key)
