"""Top N items within every group, by merging stored sorted runs.

Every input partition becomes one run: sorted by bucket of groups, group, score (highest first) and id, and cut
after N different ids of a group, so that a group of any size puts at most N rows per run into the
shuffle. The runs are stored in the shared folder. The parts of all runs that belong to one bucket then meet in
one task, which merges them group by group with a tournament of losers and, after N items, seeks to the
next group. Where there are more than ``fan_in`` runs they are merged in several levels, so that no task reads
more than ``fan_in`` runs of one group: that is what keeps a group with a third of all rows harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.plans.session import cut, width

FAN_IN = 256


def first_n(n: int):
    """Keeps the first n different ids of each group of a sorted stream of (grp, score, id), each where it stands first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group, have = None, []  # the ids taken of the group that goes on
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            group, ids = batch.column("grp"), batch.column("id").to_numpy(zero_copy_only=False)
            new = np.empty(rows, bool)
            new[0] = group[0].as_py() != last_group
            new[1:] = pc.not_equal(group.slice(1), group.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            number = np.cumsum(new)  # 0 is the group of the batch before
            if new[0]:
                have = []
            # the first row of every (group, id); a stable order keeps the rows' own
            by = np.lexsort((ids, number))
            again = np.zeros(rows, bool)
            again[by[1:]] = (ids[by[1:]] == ids[by[:-1]]) & (number[by[1:]] == number[by[:-1]])
            if have:
                again[number == 0] |= np.isin(ids[number == 0], have)
            seen = np.cumsum(~again)
            before = np.concatenate([[0], seen])[np.flatnonzero(new)]
            start = np.concatenate([[-len(have)], before])
            kept = ~again & (seen - start[number] <= n)
            last_group, at = group[rows - 1].as_py(), kept & (number == number[-1])
            have = (have if number[-1] == 0 else []) + ids[at].tolist()
            if kept.any():
                yield batch.filter(pa.array(kept))

    return run


class Losers:
    """A tournament tree over sorted runs, given as stretches (from, to) of two arrays: every inner node keeps the run that lost there, the winner is on top."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray, runs: list[tuple[int, int]]):
        self.scores, self.ids, self.at, self.end, k = scores, ids, [a for a, _ in runs], [b for _, b in runs], len(runs)
        self.tree = [-1] * k
        for leaf in range(k):
            self._replay(leaf, fill=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.at[a], self.at[b]
        if y == self.end[b] or x == self.end[a]:
            return y == self.end[b]
        return (-self.scores[x], self.ids[x], a) <= (-self.scores[y], self.ids[y], b)

    def _replay(self, winner: int, fill: bool = False) -> None:
        node = (winner + len(self.at)) // 2
        while node:
            if fill and self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[int]:
        """The places of the items, best first."""
        while self.at[r := self.tree[0]] < self.end[r]:
            yield self.at[r]
            self.at[r] += 1
            self._replay(r)


def _merge(n: int):
    """Merges the runs of each group; rows come sorted by group and run, each run in its own order."""

    def merged(x: pa.RecordBatch) -> pa.RecordBatch | None:
        if not x.num_rows:
            return None
        group, run = x.column("grp"), x.column("run").to_numpy()
        scores, ids = x.column("score").to_numpy(), x.column("id").to_numpy()
        new = np.concatenate([[True], pc.not_equal(group.slice(1), group.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)])
        edges = np.flatnonzero(new | np.concatenate([[True], run[1:] != run[:-1]]))
        first = np.flatnonzero(new[edges])  # of the stretches, those that begin a group
        ends = np.append(edges[1:], len(ids))
        taken, place = [], []
        for a, b in zip(first.tolist(), np.append(first[1:], len(edges)).tolist(), strict=True):
            done: set[int] = set()
            stretches = list(zip(edges[a:b].tolist(), ends[a:b].tolist(), strict=True))
            for at in Losers(scores, ids, stretches) if b - a > 1 else range(*stretches[0]):
                if ids[at] not in done:
                    done.add(ids[at])
                    taken.append(at)
                    place.append(len(done))
                    if len(done) == n:
                        break  # and on to the next group's first stretch, whatever is left of this one
        rows = x.take(pa.array(taken, pa.int64()))
        return pa.RecordBatch.from_arrays([rows.column(c) for c in ("grp", "score", "id")] + [pa.array(place, pa.int32())], ["grp", "score", "id", "place"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            if not x.num_rows:
                continue
            held = x if held is None else pa.concat_batches([held, x])
            group = held.column("grp")
            goes_on = pc.equal(group, group[len(group) - 1]).to_numpy(zero_copy_only=False)
            whole = len(goes_on) - int(np.argmin(goes_on[::-1])) if not goes_on.all() else 0  # its last group may go on
            if whole:
                yield merged(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield merged(held)

    return merge


def top_n(df: DataFrame, group: str, score: str, key: str, n: int = 3, fan_in: int = FAN_IN) -> DataFrame:
    """The ``n`` rows with the highest score of every group: (group, key, score, place).

    Equal scores go by the smaller key, so every run gives the same rows. Rows whose group, key
    or score is null, or whose score is NaN, don't take part; a key that comes several times in a
    group counts once, at its highest score. A smaller group gives fewer rows, an empty table
    none. Other columns are not read, whatever their names.
    """
    parts = width(df.sparkSession)
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(score).cast("double").alias("score"), F.col(key).cast("long").alias("id")).filter("grp is not null and id is not null and score is not null and not isnan(score)")
    bucket = lambda *by: F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    rows = rows.withColumn("bucket", bucket("grp")).sortWithinPartitions("bucket", "grp", F.desc("score"), "id")
    runs = cut(rows.select("grp", "score", "id").mapInArrow(first_n(n), "grp string, score double, id long").withColumn("run", F.spark_partition_id()))
    many = runs.rdd.getNumPartitions()  # of what is stored
    while many > fan_in:
        # runs of one stretch meet; what they make is one run of the next level
        stretch = F.floor(F.col("run") / fan_in).cast("int")
        met = runs.withColumn("stretch", stretch).repartitionById(parts, bucket("grp", "stretch")).sortWithinPartitions("stretch", "grp", "run", F.desc("score"), "id")
        met = met.select(F.concat_ws("\x00", F.col("stretch").cast("string"), "grp").alias("grp"), "run", "score", "id")
        at = F.split("grp", "\x00", 2)
        runs = met.mapInArrow(_merge(n), "grp string, score double, id long, place int").select(at[1].alias("grp"), "score", "id", at[0].cast("int").alias("run"))
        many = -(-many // fan_in)
    met = runs.repartitionById(parts, bucket("grp")).sortWithinPartitions("grp", "run", F.desc("score"), "id").select("grp", "run", "score", "id")
    best = met.mapInArrow(_merge(n), "grp string, score double, id long, place int")
    return best.select(F.col("grp").alias(group), F.col("id").alias(key), F.col("score").alias(score), "place")
