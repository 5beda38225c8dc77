"""Groups of texts that differ by small edits: a set-similarity self-join by rare-first prefix n-grams.

Every text is the set of its different words, put in one global order, rarest first. A pair of
sets of sizes n and m with Jaccard similarity of at least t shares at least
``o = ceil(t (n + m) / (1 + t))`` words, so that at most ``n + m - 2 o`` words stand in one of
the two only. Each such word breaks the run of equal words in the ordered sets at one place.

From every start an n-gram of neighbouring words is taken, just as long as needed for it to be
rare (product of the words' shares), and only the n-grams of a prefix count: it ends where
that many breaks, wherever they are, could no longer have destroyed all of them (the least number
of points that hits all n-grams is found greedily). A pair that is similar enough then has an
n-gram of the shorter prefix in common, which lies in the other's prefix as well: the join on prefix
n-grams loses no pair. Sets whose n-grams can't be made to survive all breaks ("open" sets) also meet
each other on n-grams of fixed, guaranteed length.

Rows of one n-gram pass the length filter, the positional filter and a filter on the rest of the set
(a bitmap of word parities, in which different words can't cancel to more bits than there are), each
pair is then verified once on the words themselves.

What is asked for are groups, so not every pair of a group is needed. An n-gram whose rows make more than
``PER_ROW`` candidates a row (a template with many variants) gives only those, between rows near each other in the order; if its sets
are not one component once these links are known, they are met, over all such n-grams together, on the parts of a partition of the words, of which two similar sets have one in common, with sets of other components
only. Representatives stand for components there, and where they don't settle it more rows are tried, so that the
groups are those that all pairs would give.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.components import connected_components
from archivolt.plans.session import cut, width

#: Counters of the word frequencies (a table of fixed size, whatever the vocabulary).
COUNTERS = 1 << 16
#: Candidates a row of one n-gram beyond which it is crowded: the rest is done by components.
PER_ROW = 16
#: Steps between the rows of one n-gram that are compared before it is crowded in any case.
LONGEST = 8192
#: Bits of the filter on ids, a fixed 4 MB.
SEEN_BITS = 1 << 25
#: Bits of a set's signature that hold its size; sets of LARGE words and more pass the filters.
SIZE_BITS = 10
#: Bits of a row's key that hold the n-gram's place in its set.
PLACE_BITS = 10
LARGE = (1 << SIZE_BITS) - 1
#: 64-bit words of the finer signature by which the sets of crowded n-grams are compared, and rows of a part of which all pairs are.
FINE, FEW = 2, 64
_MIX = 0x9E3779B97F4A7C15
_WORD = re.compile(r"[^\W_]+")
#: Bytes of ASCII text, lower-cased; what is neither letter nor digit as a space.
_ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))


def words(text: Column) -> Column:
    """The runs of letters and digits of a text, lower-cased, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


@lru_cache(maxsize=4096)
def breaks(n: int, t: float) -> int:
    """The most words that a set of n words and one similar enough can have one without the other."""
    low, high = math.ceil(t * n - 1e-9), int(n / t + 1e-9)
    # they grow with m but for the rounding, which is less than 2 of them
    near = math.ceil(2 * (1 + t) / (1 - t)) + 2 if t < 1 else 1
    return max(n + m - 2 * _overlap(n, m, t) for m in range(max(low, high - near), high + 1))


def _overlap(n: int, m: int, t: float) -> int:
    return math.ceil(t * (n + m) / (1 + t) - 1e-9)


@lru_cache(maxsize=4096)
def sure_length(n: int, t: float) -> int:
    """The length of n-gram that a set of n words shares for certain with any larger one that is similar enough."""
    best, n = 99, min(n, 400)  # it doesn't get shorter for larger sets
    for m in range(n, int(n / t + 1e-9) + 1):
        o = _overlap(n, m, t)
        best = min(best, (o - 1) // (n + m - 2 * o + 1) + 1)
    return max(1, min(best, 4))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


class Grams:
    """Turns a batch of word-hash sets into rows (key, sid, sig); the last bits of a key are the n-gram's place."""

    def __init__(self, share: np.ndarray, total: int, t: float, expected: float):
        self.t, self.limit = t, math.log(expected / max(total, expected))
        share = np.maximum(share, 1.0)
        self.log_share = np.log(share / max(total, 1)).clip(max=0)
        # rarest first by classes of frequency, within a class by hash: words that always come together
        # (and so have one frequency) would else stand side by side and make n-grams common
        self.kind = np.floor(np.log2(share)).astype(np.int64)
        self.mass = np.bincount(self.kind, share, 64) / max(total, 1)
        self.below = np.cumsum(self.mass) - self.mass

    def __call__(self, sid: np.ndarray, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        keys, sids, sigs = [], [], []
        # sets of about the same size together, so that the padded table stays small
        order = np.argsort(n, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)])
        at = 0
        while at < len(order):
            top = max(n[order[at]] * 1.3, n[order[at]] + 8)
            to = at + max(1, int(np.searchsorted(n[order[at:]], top, side="right")))
            to = min(to, at + max(1, 400_000 // int(n[order[to - 1]])))
            chosen = order[at:to]
            at = to
            part = self._rows(sid[chosen], flat, starts[chosen], n[chosen].astype(np.int64))
            for into, x in zip((keys, sids, sigs), part, strict=True):
                into.append(x)
        empty = np.empty(0, np.uint64)
        return tuple(np.concatenate(x) if x else empty for x in (keys, sids, sigs))

    def _rows(self, sid, flat, starts, n):
        rows, size, t = len(n), int(n.max()), self.t
        cols = np.arange(size)
        inside = cols < n[:, None]
        table = flat[np.where(inside, starts[:, None] + cols, 0)].astype(np.uint64)
        bucket = (table & np.uint64(COUNTERS - 1)).astype(np.int64)
        by = (self.kind[bucket].astype(np.uint64) << np.uint64(58)) | (_mixed(table) >> np.uint64(6))
        by[~inside] = np.uint64(2**64 - 1)
        turn = np.argsort(by, axis=1)
        table, bucket = np.take_along_axis(table, turn, 1), np.take_along_axis(bucket, turn, 1)
        mixed = _mixed(table)
        kind = self.kind[bucket]
        # how many words of a text are expected to stand before this place of the order
        before = self.below[kind] + self.mass[kind] * (mixed / 2.0**64)
        logs = np.concatenate([np.zeros((rows, 1)), np.cumsum(np.where(inside, self.log_share[bucket], 0.0), axis=1)], axis=1)
        long = np.zeros((rows, size), np.int64)
        for g in range(1, min(size, 24) + 1):
            between = before[:, g - 1 :] - before[:, : size + 1 - g]
            rare = (logs[:, g:] - logs[:, : size + 1 - g] - between <= self.limit) & inside[:, g - 1 :]
            head = long[:, : size + 1 - g]
            np.copyto(head, g, where=rare & (head == 0))
            if not (inside[:, g - 1 :] & (head == 0)).any():
                break
        far = size + 5
        end = np.where(long > 0, cols + long - 1, far)
        first_end = np.concatenate([np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1], np.full((rows, 2), far)], axis=1)
        most = np.array([breaks(int(k), t) for k in range(int(n.min()), size + 1)])[n - int(n.min())]
        cur, hits, prefix = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.full(rows, -1)
        every = np.arange(rows)
        for _ in range(int(most.max()) + 1):
            e = first_end[every, np.minimum(cur, size + 1)]
            go = (e < far) & (hits <= most)
            hits += go
            prefix = np.where(go, e, prefix)
            cur = np.where(go, e + 1, cur)
        opened = hits <= most
        emit = end <= np.where(opened, size, prefix)[:, None]
        # keys: a polynomial over the mixed words, as differences of prefix sums
        sums = np.zeros((rows, size + 1), np.uint64)
        base = np.uint64(0xD6E8FEB86659FD93)
        for j in range(size):
            sums[:, j + 1] = sums[:, j] * base + mixed[:, j]
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(25, base)]), dtype=np.uint64)
        # parities of the words over 54 bits, and the size
        bit = np.where(inside, np.uint64(1) << (mixed >> np.uint64(20)) % np.uint64(64 - SIZE_BITS), np.uint64(0))
        sig = (np.bitwise_xor.reduce(bit, axis=1) << np.uint64(SIZE_BITS)) | np.minimum(n, LARGE).astype(np.uint64)
        r, c = np.nonzero(emit)
        g = long[r, c]
        keys, owners, places = [_mixed(sums[r, c + g] - sums[r, c] * powers[g])], [r], [c]
        if opened.any():  # short n-grams of certain length, met by open sets only
            for k in np.nonzero(opened)[0]:
                size_k = int(n[k])
                for g1 in {sure_length(m, t) for m in range(max(1, math.ceil(t * size_k - 1e-9)), size_k + 1)}:
                    s = np.arange(size_k - g1 + 1)
                    keys.append(_mixed((sums[k, s + g1] - sums[k, s] * powers[g1]) ^ np.uint64(_MIX + g1)))
                    owners.append(np.full(len(s), k))
                    places.append(s)
        owner = np.concatenate(owners)
        place = np.minimum(np.concatenate(places), (1 << PLACE_BITS) - 1).astype(np.uint64)
        return (np.concatenate(keys) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place, sid[owner], sig[owner]


def _similar(sig_a: np.ndarray, sig_b: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray, t: float) -> np.ndarray:
    """Which pairs pass the filters on length, on the places of the n-gram, and on the parities of all words."""
    odd = np.bitwise_count((sig_a ^ sig_b) >> np.uint64(SIZE_BITS))
    n, m = (sig_a & np.uint64(LARGE)).astype(np.int64), (sig_b & np.uint64(LARGE)).astype(np.int64)
    o = np.ceil(t * (n + m) / (1 + t) - 1e-9)
    # before the n-gram and from it on, the two can't share more words than the one with fewer has there
    shared = np.minimum(pos_a, pos_b) + np.minimum(n - pos_a, m - pos_b)
    last = (1 << PLACE_BITS) - 1
    placed = (shared >= o) | (pos_a == last) | (pos_b == last)
    return ((np.minimum(n, m) >= o) & placed & (odd <= n + m - 2 * o)) | (np.maximum(n, m) == LARGE)


def _pairs(t: float, per_row: int, longest: int):
    """Pairs the rows of each n-gram in a stream sorted by (key, sid); rows of crowded n-grams pass through as well."""

    # the most odd words that two sets may have, by the sum of their sizes; any number where one may be of LARGE
    sums = np.arange(2 * LARGE + 1)
    allowed = np.where(sums < LARGE, np.maximum(sums - 2 * np.ceil(t * sums / (1 + t) - 1e-9), -1), 64).astype(np.int8)

    def close(key, sid, sig, pos, hot):
        """Batches of candidate pairs, then the rows of crowded n-grams; ``hot`` is one for certain."""
        odd, sizes = sig >> np.uint64(SIZE_BITS), (sig & np.uint64(LARGE)).astype(np.int32)
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(begins) - 1
        rows = np.diff(np.append(np.flatnonzero(begins), len(key)))
        found, crowded = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        large = rows > 2 * longest
        if hot is not None:
            large |= key[begins] == hot
        after = np.repeat(np.cumsum(rows), rows) - np.arange(len(key))  # rows of the n-gram from each on
        at, step, held, size = np.arange(len(key) - 1), 1, [], 0
        while len(at):
            at = at[after[at] > step]
            to = at + step
            ok = at[np.bitwise_count(odd[at] ^ odd[to]) <= allowed[sizes[at] + sizes[to]]]  # most pairs fail here
            ok = ok[sid[ok] != sid[ok + step]]
            ok = ok[_similar(sig[ok], sig[ok + step], pos[ok], pos[ok + step], t)]
            if len(ok):
                x, y = sid[ok], sid[ok + step]
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                size += len(ok)
                np.add.at(found, number[ok], 1)
            if step % 8 == 0:
                crowded |= (found > per_row * rows) | large
                if step >= longest:
                    crowded[number[at]] = True
                at = at[~crowded[number[at]]]
            if size >= 500_000:
                yield paired(held)
                held, size = [], 0
            step += 1
        if held:
            yield paired(held)
        crowded |= large
        if crowded.any():
            on = crowded[number]
            yield batch(sid[on], None, key[on], sig[on])

    def paired(held):
        both = np.concatenate(held)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])]
        return batch(both[:, 0], both[:, 1])

    def batch(a, b, key=None, sig=None):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b), none if sig is None else pa.array(sig.view(np.int64))], ["key", "a", "b", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, hot = 0, None
        for x in batches:
            cols = [x.column(c).to_numpy() for c in ("key", "sid", "sig")]
            if not len(cols[0]):
                continue
            held.append((cols[0] >> PLACE_BITS, cols[1], cols[2].view(np.uint64), cols[0] & ((1 << PLACE_BITS) - 1)))
            count += len(cols[0])
            if count < 200_000:
                continue
            key, sid, sig, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))  # the last n-gram may go on
            done = slice(0, last)
            yield from flush(key[done], sid[done], sig[done], pos[done], hot)
            if len(key) - last > 2 * longest or key[-1] == hot:  # too long for a task to hold: crowded; a few rows are kept to link what follows
                hot = key[-1]
                yield from flush(key[last:], sid[last:], sig[last:], pos[last:], hot)
                last = max(last, len(key) - 8)
            held, count = [(key[last:], sid[last:], sig[last:], pos[last:])], len(key) - last
        if held:
            yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)), hot)

    def flush(key, sid, sig, pos, hot):
        if not len(key):
            return
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]) | (pos[1:] != pos[:-1])])  # copies of a set once
        key, sid, sig, pos = key[new], sid[new], sig[new], pos[new]
        yield from close(key, sid, sig, pos, hot)

    return run


def _hashed(ids: list[int], texts: list[str], known: dict[str | bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sids, sizes, tokens) of the texts that hold a word: one hash of each set of words, its size, and its word hashes, sorted."""
    kept, sids, flat = [], [], []
    for i, t in zip(ids, texts, strict=True):
        # as bytes or not, a word has the same hash
        found = set(t.encode().translate(_ASCII).split() if t.isascii() else _WORD.findall(t.lower()))
        if not found:
            continue
        try:
            tokens = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        except KeyError:
            known.update((w, xxhash.xxh64_intdigest(w) - (1 << 63)) for w in found.difference(known))
            tokens = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        tokens.sort()
        kept.append(i)
        sids.append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
        flat.append(tokens)
    if len(known) > 1_000_000:  # bounded; words come again
        known.clear()
    sizes = np.array([len(x) for x in flat], np.int64)
    return np.array(kept, np.int64), np.array(sids, np.int64), sizes, np.concatenate(flat) if flat else np.empty(0, np.int64)


def _columns(x: pa.RecordBatch, known: dict[str, int]):
    return _hashed(x.column("id").to_pylist(), x.column("text").to_pylist(), known)


def _marked(rows: DataFrame, column: str):
    """A broadcast bitmap of fixed size of the numbers in a column, modulo its size."""
    cell = f"pmod({column}, {SEEN_BITS})"
    marks = rows.groupBy(F.expr(f"cast({cell} div 64 as long)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({cell} % 64 as int))")).alias("bits"))
    table = np.zeros(SEEN_BITS // 64, np.int64)
    for w, bits in marks.collect():  # at most SEEN_BITS / 64 rows, however many numbers
        table[w] = bits
    return rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _among(x: pa.RecordBatch, column: str, table: np.ndarray) -> pa.RecordBatch:
    """The rows whose number may be one of those marked."""
    at = np.mod(x.column(column).to_numpy(), SEEN_BITS)
    return x.filter(pa.array(((table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)))


class Texts:
    """Texts by id, with the hash of each one's set of words, and how often words occur: one pass over them."""

    def __init__(self, df: DataFrame, key: str, text: str):
        self.rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, seen = {}, np.zeros(COUNTERS + 1, np.int64)
            for x in batches:
                ids, sids, _, tokens = _columns(x, known)
                if len(ids):
                    seen[:COUNTERS] += np.bincount(tokens & (COUNTERS - 1), minlength=COUNTERS)
                    seen[COUNTERS] += len(ids)
                    none = pa.nulls(len(ids), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sids), none, none], ["id", "sid", "c", "n"])
            at = np.flatnonzero(seen)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(at), pa.array(seen[at])], ["id", "sid", "c", "n"])

        both = cut(self.rows.mapInArrow(first, "id long, sid long, c long, n long"))
        self.ids = both.filter("c is null").select("id", "sid")
        share = np.zeros(COUNTERS + 1)
        for c, n in both.filter("c is not null").groupBy("c").agg(F.sum("n")).collect():  # at most COUNTERS + 1 rows
            share[c] = n
        self.share, self.total = share[:COUNTERS], int(share[COUNTERS])
        self.lead = self.ids.groupBy("sid").agg(F.min("id").alias("id"))

    def sets(self, sids: DataFrame) -> DataFrame:
        """(sid, tokens) of a table of sids: only texts that one of them needs are taken apart and shuffled."""
        ids = sids.join(self.lead, "sid").select("id")
        wanted = _marked(ids, "id")

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, int] = {}
            for x in batches:
                _, sids, sizes, tokens = _columns(_among(x, "id", wanted.value), known)
                if len(sids):
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(sids), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], ["sid", "tokens"])

        return self.rows.mapInArrow(named, "sid long, tokens array<long>").dropDuplicates(["sid"])


def linking_pairs(texts: Texts, t: float = 0.8, expected: float = 128.0, per_row: int = PER_ROW, longest: int = LONGEST) -> DataFrame:
    """(a, b): pairs of different sets (by sid, a < b) with a Jaccard similarity of at least ``t``: enough of them that
    the sets they join, directly or through others, are those that all such pairs join.

    ``expected`` is the number of sets an n-gram is expected to be shared by, by chance: it balances
    the number of n-grams against that of candidates; like ``per_row`` and ``longest`` it has no influence on the groups.
    """
    spark, total = texts.rows.sparkSession, texts.total
    share = spark.sparkContext.broadcast(texts.share)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, known = Grams(share.value, total, t, expected), set(), {}
        for x in batches:
            _, sid, n, flat = _columns(x, known)
            # a set that this task has had gives the same rows again; the memory of it is bounded
            fresh = np.zeros(len(sid), bool)
            for i, s in enumerate(sid.tolist()):
                if s not in seen:
                    fresh[i] = True
                    seen.add(s)
            if len(seen) > 500_000:
                seen = set()
            if not fresh.any():
                continue
            flat, sid, n = flat[np.repeat(fresh, n)], sid[fresh], n[fresh]
            key, own, sig = make(sid, flat, n)
            key = key.view(np.int64)
            for i in range(0, len(key), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(own[s]), pa.array(sig[s].view(np.int64))], ["key", "sid", "sig"])

    rows = texts.rows.mapInArrow(grams, "key long, sid long, sig long")
    met = rows.repartition(width(spark), F.shiftright("key", PLACE_BITS)).sortWithinPartitions("key", "sid").mapInArrow(_pairs(t, per_row, longest), "key long, a long, b long, sig long")
    met = cut(met)
    found = _verified(texts, met.filter("b is not null").select("a", "b").distinct(), t)
    crowded = met.filter("b is null").select("key", F.col("a").alias("sid"), "sig").distinct()
    if crowded.isEmpty():
        return found
    return _crowded(texts, cut(found), crowded, t)


def _crowded(texts: Texts, links: DataFrame, crowded: DataFrame, t: float) -> DataFrame:
    """``links`` and as many more as the sets of crowded n-grams (key, sid) need to be joined as all their pairs would."""

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))

    of = connected_components(links)
    # an n-gram all of whose sets are one component is done
    rows = placed(crowded.select("key", "sid"), of)
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    rest = cut(rows.join(mixed, "key").select("sid").distinct())
    if rest.isEmpty():
        return links
    # with their components before they are stored, as they are in the order of the join then
    sets = cut(placed(texts.sets(rest), of))
    most, spark = 4, texts.rows.sparkSession
    while True:
        parts = sets.select("sid", "component", "tokens").mapInArrow(_parted(t), "part long, component long, sid long, sig long, fine binary")
        met = cut(parts.repartition(width(spark), "part").sortWithinPartitions("part", "component", "sid").mapInArrow(_across(t, most), "a long, b long"))
        pairs = met.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(pairs)
        links = links.unionByName(cut(_alike(pairs, _of(pairs, sets), t)))
        if met.filter("b is null").isEmpty():
            return links
        sets = cut(placed(sets.drop("component"), connected_components(links)))
        most *= 8  # components that their first rows didn't join: more of them


def _parted(t: float):
    """(part, component, sid, sig, fine): keys of which any two sets (sid, component, tokens) with a similarity of at least ``t`` have one in common.

    Sizes are divided into classes, such that similar sets are of one class or of two neighbouring ones. Two similar sets of
    up to N words differ in at most ``2 N (1 - t) / (1 + t)`` words, so that of one part more, into which all words are
    divided by their hash, one holds the same words in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = [1]
        for x in batches:
            all_keys, sizes, sigs, fine = [], [], [], []
            for tokens in x.column("tokens"):
                words = _mixed(tokens.values.to_numpy(zero_copy_only=False).view(np.uint64))
                while begins[-1] <= len(words):
                    begins.append(int(begins[-1] / t + 1e-9) + 1)
                own = int(np.searchsorted(begins, len(words), side="right")) - 1
                keys = []
                for level in (own, own + 1):
                    while len(begins) < level + 2:
                        begins.append(int(begins[-1] / t + 1e-9) + 1)
                    many = int(2 * (begins[level + 1] - 1) * (1 - t) / (1 + t) + 1e-9) + 1
                    sums = np.zeros(many, np.uint64)
                    np.add.at(sums, ((words >> np.uint64(33)) % np.uint64(many)).astype(np.int64), _mixed(words))
                    keys.append(_mixed(sums + np.uint64(level * _MIX % 2**64) + (np.arange(many, dtype=np.uint64) << np.uint64(40))))
                bits = np.bitwise_xor.reduce(np.uint64(1) << (words >> np.uint64(20)) % np.uint64(64 - SIZE_BITS))
                finer = np.zeros(FINE, np.uint64)
                np.bitwise_xor.at(finer, (words & np.uint64(FINE - 1)).astype(np.int64), np.uint64(1) << (words >> np.uint64(8)) % np.uint64(64))
                fine.append(finer.tobytes())
                sigs.append((int(bits) << SIZE_BITS) | min(len(words), LARGE))
                all_keys.append(np.concatenate(keys).view(np.int64))
                sizes.append(len(all_keys[-1]))
            if sizes:
                of = lambda c: pa.array(np.repeat(c, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(all_keys)), of(x.column("component").to_numpy()), of(x.column("sid").to_numpy()), of(np.array(sigs, np.uint64).view(np.int64)), pa.array(fine, pa.binary()).take(of(np.arange(len(fine))))], ["part", "component", "sid", "sig", "fine"])

    return run


def _across(t: float, most: int):
    """Pairs of sets of one part and different components, in a stream sorted by (part, component, sid): of every two components
    the first ``most`` that pass the filters; where there are more, a row without b says so."""

    zero = np.zeros(1, np.int64)

    def near(sig, fine, x, y):
        n, m = (sig[x] & np.uint64(LARGE)).astype(np.int64), (sig[y] & np.uint64(LARGE)).astype(np.int64)
        odd = np.bitwise_count(fine[x] ^ fine[y]).sum(axis=1)
        return _similar(sig[x], sig[y], zero, zero, t) & ((odd <= n + m - 2 * np.ceil(t * (n + m) / (1 + t) - 1e-9)) | (np.maximum(n, m) == LARGE))

    def of_part(component, sid, sig, fine):
        edge = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1], [True]]))
        cols = np.arange(len(sid))
        for low, high in zip(edge[:-2].tolist(), edge[1:-1].tolist(), strict=True):
            taken = np.zeros(len(edge), np.int64)  # of each later component
            number = np.searchsorted(edge, cols[high:], side="right")
            for i in range(low, high):
                ok = near(sig, fine, np.full(len(number), i), cols[high:])
                if not ok.any():
                    continue
                to = number[ok]
                begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                rank = np.arange(len(to)) - np.repeat(begin, np.diff(np.append(begin, len(to)))) + taken[to]
                np.add.at(taken, to, 1)
                kept = sid[high:][ok][rank < most]
                yield np.full(len(kept), sid[i]), kept, bool((rank >= most).any())
                if (taken[number[0] :] >= most).all():  # each later component has had its share of this one
                    yield kept[:0], kept[:0], i + 1 < high
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def pairs(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def flush(rows):
            part, component, sid, sig, fine = (np.concatenate(c) for c in zip(*rows, strict=True))
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            size = np.diff(edge)
            # in small parts all pairs, a step at a time over all of them
            at, step = np.flatnonzero(np.repeat(size <= FEW, size)), 1
            while len(at):
                at = at[(at + step) < len(part)]
                at = at[part[at] == part[at + step]]
                x = at[component[at] != component[at + step]]
                x = x[near(sig, fine, x, x + step)]
                if len(x):
                    yield pairs(sid[x], sid[x + step])
                step += 1
            more = False
            for low, high in zip(edge[:-1][size > FEW].tolist(), edge[1:][size > FEW].tolist(), strict=True):
                if component[low] == component[high - 1]:
                    continue
                for x, y, left in of_part(component[low:high], sid[low:high], sig[low:high], fine[low:high]):
                    if len(x):
                        yield pairs(x, y)
                    more |= left
            if more:
                yield pairs([0], [None])

        for x in batches:
            if not x.num_rows:
                continue
            fine = np.frombuffer(b"".join(x.column("fine").to_pylist()), np.uint64).reshape(-1, FINE)
            held.append([*(x.column(c).to_numpy() for c in ("part", "component", "sid")), x.column("sig").to_numpy().view(np.uint64), fine])
            if sum(len(c[0]) for c in held) < 100_000:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last part may go on
            if last:
                yield from flush([[c[:last] for c in rows]])
            held = [[c[last:] for c in rows]]
        if held:
            yield from flush(held)

    return run


def _verified(texts: Texts, pairs: DataFrame, t: float) -> DataFrame:
    """The pairs whose words really are that similar; each is looked at once."""
    pairs = cut(pairs)
    return _alike(pairs, texts.sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()), t)


def _of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the sets that stand in pairs: others needn't be moved."""
    wanted = _marked(pairs.select(F.explode(F.array("a", "b")).alias("sid")), "sid")
    return sets.mapInArrow(lambda batches: (_among(x, "sid", wanted.value) for x in batches), sets.schema)


def _alike(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    # parities of the words over 256 bits first: they are small to move, and few pairs are left whose words are
    parity = [F.expr(f"aggregate(filter(tokens, w -> (w & 3) = {i}), 0L, (acc, w) -> acc ^ shiftleft(1L, cast(shiftright(w, 2) & 63 AS int)))") for i in range(4)]
    marks = sets.select("sid", F.struct(F.size("tokens").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parity)]).alias("m"))
    met = pairs.join(marks.select(F.col("sid").alias("a"), F.col("m").alias("x")), "a").join(marks.select(F.col("sid").alias("b"), F.col("m").alias("y")), "b")
    odd = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(4)), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    pairs = met.filter(odd <= both - 2 * F.ceil(F.lit(t) * both / (1 + t) - 1e-9)).select("a", "b")
    x, y = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    same = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(y, "b").join(x, "a").filter(same >= F.lit(t) * (F.size("ta") + F.size("tb") - same) - 1e-9).select("a", "b")


def near_duplicate_groups(df: DataFrame, key: str, text: str, t: float = 0.8, per_row: int = PER_ROW, longest: int = LONGEST) -> DataFrame:
    """(key, group_id): every row that is near-duplicate of another, with the smallest key of its group.

    Rows of one key count once. Texts with the same set of words are one class and near each other. A group is all rows
    linked directly or through others. Texts that are null or hold no word are near nothing. Other columns are
    not read, whatever their names.
    """
    texts = Texts(df, key, text)
    of = connected_components(linking_pairs(texts, t, per_row=per_row, longest=longest))
    rows = texts.ids.distinct()
    rows = rows.join(of, rows.sid == of.node, "left").select("id", F.coalesce("component", "sid").alias("root"))
    groups = rows.groupBy("root").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("n")).filter("n > 1").drop("n")
    return rows.join(groups, "root").select(F.col("id").alias(key), "group_id")
