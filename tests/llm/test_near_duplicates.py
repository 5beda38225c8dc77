import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm import near_duplicates
from archivolt.llm.near_duplicates import FINE, Texts, _across, _parted, breaks, linking_pairs, near_duplicate_groups, sure_length


def plain(rows, t=0.8):
    """The groups by comparing all pairs."""
    sets = {}
    for i, text in rows:
        if i is not None and text is not None and (w := frozenset(re.findall(r"[^\W_]+", text.lower()))):
            sets.setdefault(i, set()).add(w)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(len(x & y) >= t * len(x | y) - 1e-9 for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    size = Counter(root(i) for i in ids)
    return {(i, root(i)) for i in ids if size[root(i)] > 1}


def texts(seed, n=260):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(15)]
    rare = [f"r{i}" for i in range(150)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:  # an edited copy of an earlier one
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 6))):
                k = rng.random()
                at = rng.randrange(len(words) + 1)
                if k < 0.4 and len(words) > 1:
                    words.pop(at % len(words))
                elif k < 0.8:
                    words.insert(at, rng.choice(rare))
                else:
                    rng.shuffle(words)
        else:
            words = [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12, 25, 60]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, per_row, longest", [(1, 16, 8192), (2, 16, 8192), (3, 0, 8), (4, 1, 8)])
def test_against_all_pairs(spark, seed, per_row, longest):
    rows = texts(seed)
    rows += rows[:20] + [(900, None), (901, ""), (902, "—"), (None, "c1 c2")]
    rows += [(1000 + i, "The SAME text, again and again: c1 c2 r1 r2 r3.") for i in range(80)]  # copies
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "record_id long, content string, sid string, key int").repartition(5)
    got = near_duplicate_groups(df, "record_id", "content", per_row=per_row, longest=longest)
    assert {(r.record_id, r.group_id) for r in got.collect()} == plain(rows)
    assert got.count() == len({r.record_id for r in got.collect()})


def test_a_family_of_edited_copies_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(40)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    for per_row in (16, 0):
        got = near_duplicate_groups(spark.createDataFrame(rows, "record_id long, content string"), "record_id", "content", per_row=per_row, longest=16)
        assert {(r.record_id, r.group_id) for r in got.collect()} == plain(rows)


def test_a_template_with_many_variants(spark):
    """Candidates grow with the texts, not with their pairs."""
    rows = [(i, " ".join([f"t{k}" for k in range(30)] + [f"own{i}"])) for i in range(1500)]
    rows += [(5000 + i, " ".join([f"t{k}" for k in range(30)] + [f"u{i}x{k}" for k in range(20)])) for i in range(40)]  # near nothing
    found = Texts(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    pairs = linking_pairs(found)
    assert pairs.count() < 40 * len(rows)
    got = near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert {(r.id, r.group_id) for r in got} == {(i, 0) for i in range(1500)}


def test_similar_sets_share_a_part():
    rng = random.Random(3)
    for n in (1, 2, 4, 9, 10, 30, 61, 200):
        for _ in range(40):
            one = {rng.randrange(1 << 62) for _ in range(n)}
            other = set(one)
            while True:  # as far from it as can be
                more = set(other)
                more.discard(rng.choice(sorted(more))) if rng.random() < 0.5 else more.add(rng.randrange(1 << 62))
                if not more or len(one & more) < 0.8 * len(one | more):
                    break
                other = more
            x = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([sorted(one), sorted(other)], pa.list_(pa.int64()))], ["sid", "component", "tokens"])
            rows = next(_parted(0.8)(iter([x]))).to_pylist()
            a, b = ({r["part"] for r in rows if r["sid"] == i} for i in (1, 2))
            assert a & b


@pytest.mark.parametrize("most", [1, 3, 100])
def test_pairs_across_components(most, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FEW", 0)
    rng = np.random.default_rng(most)
    part, component = np.sort(rng.integers(0, 3, 60)), rng.integers(0, 4, 60)
    order = np.lexsort((component, part))
    cols = [part[order], component[order], np.arange(60), np.full(60, 10)]
    x = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([bytes(8 * FINE)] * 60)], ["part", "component", "sid", "sig", "fine"])
    got = [r for y in _across(0.8, most)(iter([x])) for r in y.to_pylist()]
    for p in range(3):
        for c in range(4):
            for d in range(c + 1, 4):
                x, y = (np.flatnonzero((cols[0] == p) & (cols[1] == k)) for k in (c, d))
                assert sum(r["b"] is not None and r["a"] in x and r["b"] in y for r in got) == min(most, len(x) * len(y))
    assert any(r["b"] is None for r in got) == (most < 100)


def test_empty_table(spark):
    assert near_duplicate_groups(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[2000:])), (3, " ".join(words[:20_000])), (4, " ".join(words[:10] * 3000)), (5, " ".join(words[:11]))]
    got = near_duplicate_groups(spark.createDataFrame(rows, "record_id long, content string"), "record_id", "content").collect()
    assert {(r.record_id, r.group_id) for r in got} == {(1, 1), (2, 1), (4, 4), (5, 4)}


def test_bounds_are_those_of_a_full_search():
    for n in (1, 2, 5, 17, 53, 400, 1001):
        for t in (0.5, 0.8, 0.9):
            sizes = range(-(-int(t * n * 1000) // 1000), int(n / t + 1e-9) + 1)
            assert breaks(n, t) == max(n + m - 2 * math.ceil(t * (n + m) / (1 + t) - 1e-9) for m in sizes if m >= t * n - 1e-9)


def test_bounds_hold():
    for n in range(1, 60):
        for m in range(n, 80):
            for o in range(n + 1):
                if o >= 0.8 * (n + m - o) - 1e-9:
                    assert n + m - 2 * o <= min(breaks(n, 0.8), breaks(m, 0.8))
                    assert (n + m - 2 * o + 1) * (sure_length(n, 0.8) - 1) + 1 <= o


def test_a_word_has_one_hash_as_bytes_or_not():
    texts = ["The Old-rope_of 12 ports\x1f!", "The Old-rope_of 12 ports é!", "the old rope of 12 ports É"]
    ids, sids, sizes, tokens = near_duplicates._hashed([1, 2, 3], texts, {})
    parts = np.split(tokens, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [6, 7, 7] and set(parts[0]) < set(parts[1]) and parts[1].tolist() == parts[2].tolist() and sids[1] == sids[2] != sids[0]


def test_pairs_that_differ_in_too_many_words_are_left_out_first(monkeypatch):
    """Most pairs of one n-gram fail on the parities of their words, which are looked at before all else."""
    seen, similar = [], near_duplicates._similar
    monkeypatch.setattr(near_duplicates, "_similar", lambda a, *rest: seen.append(len(a)) or similar(a, *rest))
    rng = np.random.default_rng(3)
    sig = (rng.integers(0, 1 << 54, 300, np.int64).view(np.uint64) << np.uint64(10)) | np.uint64(40)
    sig[7] = sig[8] = sig[250]
    x = pa.RecordBatch.from_arrays([pa.array(np.zeros(300, np.int64)), pa.array(np.arange(300)), pa.array(sig.view(np.int64))], ["key", "sid", "sig"])
    found = [(a, b) for y in near_duplicates._pairs(0.8, 16, 8192)(iter([x])) for a, b in zip(y.column("a").to_pylist(), y.column("b").to_pylist(), strict=True)]
    assert sorted(found) == [(7, 8), (7, 250), (8, 250)] and sum(seen) == 3
