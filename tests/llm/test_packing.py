import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from accordia.llm import common, packing
from accordia.llm.bpe import encoder


def check(rows, room=packing.ROOM):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    room = 100
    lengths = rng.integers(1, room + 1, 400) if seed < 3 else rng.choice([100, 51, 50, 34, 33, 7, 1], 400)
    hist = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    fill: dict = {}
    for length, first, count, sequence, at, per in packing.plan(hist, room):
        for i in range(count):
            fill.setdefault(sequence + i // per, []).append((at + i % per * length, length))
        assert first + count <= hist[length]
    assert sum(map(len, fill.values())) == len(lengths)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    bins: list = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= n]
        if fits:
            k = min(fits, key=bins.__getitem__)
            bins[k] -= n
        else:
            bins.append(room - n)
    assert len(fill) == len(bins)


def test_query(spark, sf, local):
    rows = packing.op7_best_fit_packing(spark, sf).collect()
    e, want = encoder(packing.TOKENIZER), {}
    for i, d in local.items():
        raw = e.whole(d.text) + bytes(4)
        n = len(raw) // 4
        cuts = list(range(n % packing.ROOM or packing.ROOM, n + 1, packing.ROOM)) if n > packing.ROOM else [n]
        start = 0
        for k, end in enumerate(cuts):
            want[i, k] = (start, end - start, zlib.crc32(raw[4 * start : 4 * end]))
            start = end
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check(rows) <= -(-sum(v[1] for v in want.values()) // packing.ROOM) * 1.02 + 1


def test_plan_too_large_to_send(spark, sf, monkeypatch):
    want = sorted(map(str, packing.op7_best_fit_packing(spark, sf).select("doc_id", "piece", "length").collect()))
    monkeypatch.setattr(packing, "SENT", -1)
    rows = packing.op7_best_fit_packing(spark, sf)
    check(rows.collect())
    assert sorted(map(str, rows.select("doc_id", "piece", "length").collect())) == want


def test_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id == 4}) > 20 and sum(r.length == 1 for r in rows) == 3
    assert sum(r.piece == 0 for r in rows) == odd.count()
    check(rows)
    assert packing.pack(empty).count() == 0


def test_texts_are_encoded_in_small_slices():
    """Two workers' arrays of 3 MB of text each took an executor over its memory in the pipeline."""
    texts = pa.record_batch({"text": ["word " * 1000] * 1500})
    runs = [pc.sum(pc.binary_length(x.column("text"))).as_py() for x in common.slices(texts, "text", packing.SLICE)]
    assert sum(runs) == 7_500_000 and max(runs) < 1.1 * 2**20
