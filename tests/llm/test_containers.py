from collections import defaultdict

import numpy as np
import pyarrow as pa

from archivolt.llm.containers import _encoder, _packed, PATTERN, STRETCH, VOCABULARY, containers, hilbert


def test_hilbert_is_a_path_through_every_cell():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), axis=-1).reshape(-1, n)
        key = hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_whole_texts_in_full_containers(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = containers(df).collect()
    size = {r.doc_id: len(_encoder(VOCABULARY, PATTERN).encode_ordinary(r.text)) for r in df.filter("text is not null").collect()}
    pieces, used = defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[r.doc_id].append((r.start_token, r.tokens))
        used[r.container] += r.tokens
    assert max(used.values()) <= 2048
    assert set(pieces) == set(size)
    for k, parts in pieces.items():
        parts.sort()
        assert sum(n for _, n in parts) == size[k]
        assert len(parts) == max(1, -(-size[k] // 2048))
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert len(used) <= sum(size.values()) / 2048 + 4 + 1


def test_what_is_packed_together_are_neighbours():
    """Containers hold items of a short part of the curve, and are full."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 900, 3000)
    x = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(sizes)], ["key", "tokens"])
    found = pa.Table.from_batches(_packed(iter([x.slice(0, 1000), x.slice(1000)]), 2048, 0)).to_pandas()
    assert sorted(found.key) == list(range(3000))
    spread = found.groupby("container").key.agg(lambda k: k.max() - k.min())
    assert spread.median() <= 2 * STRETCH
    assert sizes.sum() / (found.container.nunique() * 2048) > 0.98


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 5000), (None, "x")]
    got = containers(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, container int")).collect()
    assert sorted({r.doc_id for r in got}) == [2, 3, 4]
    assert sum(r.doc_id == 3 for r in got) == 2
    assert containers(spark.createDataFrame([], "doc_id long, text string")).count() == 0
