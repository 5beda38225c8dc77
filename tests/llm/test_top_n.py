import random

import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm.top_n import Losers, first_n, top_n


def plain(rows, n):
    best = {}
    for g, s, k in rows:
        if g is not None and k is not None and s is not None and s == s:
            best.setdefault(g, {})[k] = max(s, best.get(g, {}).get(k, s))
    return {(g, k, i) for g, ks in best.items() for i, (k, _) in enumerate(sorted(ks.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


@pytest.mark.parametrize("fan_in", [256, 2])
def test_against_sorting(spark, fan_in):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None, "d\x00e"]), rng.choice([0.5, 0.25, -1.0, float("nan"), None, 0.0, -0.0, rng.random()]), rng.choice([None, *range(40)])) for _ in range(900)]
    rows += rows[:200]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "grp string, score double, id long, run string, place int").repartition(7)
    got = {(r.grp, r.id, r.place) for r in top_n(df, "grp", "score", "id", 3, fan_in).collect()}
    assert got == plain(rows, 3)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, s double, k long"), "g", "s", "k").count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_losers_merge_in_order(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), i) for i in range(rng.randint(0, 12))) for _ in range(k)]
    flat = [x for r in runs for x in r]
    ends = np.cumsum([len(r) for r in runs]).tolist()
    stretches = list(zip([0, *ends[:-1]], ends, strict=True))
    scores, ids = np.array([-s for s, _ in flat], float), np.array([i for _, i in flat], np.int64)
    assert [flat[at] for at in Losers(scores, ids, stretches)] == sorted(flat)


def test_a_key_that_comes_again_takes_one_place(spark):
    rows = [("g", 9.0, 1), ("g", 8.0, 2), ("g", 7.0, 1), ("g", 6.0, 3), ("h", 5.0, 1)]
    got = top_n(spark.createDataFrame(rows, "g string, s double, k long").coalesce(1), "g", "s", "k", 3)
    assert {(r.g, r.k, r.s, r.place) for r in got.collect()} == {("g", 1, 9.0, 1), ("g", 2, 8.0, 2), ("g", 3, 6.0, 3), ("h", 1, 5.0, 1)}


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_first_n_over_batches(size):
    rng = random.Random(size)
    rows = sorted(((rng.randint(0, 4), -rng.randint(0, 9), rng.randint(0, 6)) for _ in range(300)))
    batches = []
    for i in range(0, len(rows), size):
        g, s, k = zip(*rows[i : i + size], strict=True)
        batches.append(pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([float(-x) for x in s]), pa.array(k, pa.int64())], ["grp", "score", "id"]))
    got = [(r["grp"], r["score"], r["id"]) for b in first_n(3)(iter(batches)) for r in b.to_pylist()]
    want, seen = [], {}
    for g, s, k in rows:
        if k not in seen.setdefault(g, []) and len(seen[g]) < 3:
            seen[g].append(k)
            want.append((g, float(-s), k))
    assert got == want
