import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from accordia.llm import lm


@pytest.mark.parametrize(("universe", "n"), [(1 << 63, 1000), (100, 50), (5, 5), (1, 1), (1000, 0), (10**12, 20000), (7, 7)])
def test_elias_fano(universe, n):
    rng = np.random.default_rng(universe % 97)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
    raw = np.frombuffer(lm.EliasFano.build(v, universe), np.uint8)
    e = lm.EliasFano(raw)
    assert e.end == len(raw) and (e.get(np.arange(len(v))) == v).all()
    at = {int(x): i for i, x in enumerate(v)}
    probe = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
    assert e.find(probe).tolist() == [at.get(int(x), -1) for x in probe]


def test_repeated_values():
    v = np.array([0, 0, 3, 3, 3, 9], np.uint64)
    assert lm.EliasFano(np.frombuffer(lm.EliasFano.build(v, 10), np.uint8)).get(np.arange(6)).tolist() == v.tolist()


def test_counts_round_trip():
    k = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 500, dtype=np.uint64))
    a, b = lm.unpack_counts(lm.pack_counts(k, np.arange(len(k))))
    assert (a == k).all() and (b == np.arange(len(k))).all()
    keys, counts = lm.merge_counts([(k, np.ones(len(k), np.int64)), (k[:9], np.ones(9, np.int64))])
    assert (keys == k).all() and counts.sum() == len(k) + 9


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*(text or "").translate(lower).encode().split(), None]


def test_scores_against_counting(spark, sf, local):
    got = {r.doc_id: r for r in lm.op4_lm_scoring(spark, sf).collect()}
    assert got.keys() == local.keys()
    texts = {i: words(d.text) for i, d in local.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in texts[i])
    pairs = Counter(p for i in train for p in zip(texts[i], texts[i][1:], strict=False))
    kinds, n, v = Counter(a for a, _ in pairs), sum(c.values()), len(c)
    for i, w in texts.items():
        r = got[i]
        alone = [math.log10((c[x] + 1) / (n + v + 1)) for x in w]
        model = alone[0]
        for a, x in zip(w, w[1:], strict=False):
            one = (c[x] + 1) / (n + v + 1)
            model += math.log10((max(pairs[a, x] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[a] * one) / c[a] if c[a] else one)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(alone), rel=1e-9)
        # each of two quantised parts is off by half a step at most
        assert abs(r.score - model) <= 0.05 * len(w)


def test_probabilities_sum_to_one():
    c, pairs = Counter(a=6, b=3, e=3), {("a", "a"): 2, ("a", "b"): 3, ("a", "e"): 1}
    n, v = sum(c.values()), len(c)
    p = [(max(pairs.get(("a", x), 0) - lm.DISCOUNT, 0) + lm.DISCOUNT * 3 * (c[x] + 1) / (n + v + 1)) / c["a"] for x in (*c, "unknown")]
    assert sum(p) == pytest.approx(1)


def test_odd_rows(odd, empty):
    got = lm.scores(odd, lm.train(odd)).collect()
    assert len(got) == odd.count() and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 5))
    assert all(r.score <= 0 and r.base_score <= 0 for r in got)
    nothing = lm.scores(odd, lm.train(empty)).collect()
    assert len(nothing) == len(got) and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in nothing)
    assert lm.scores(empty, lm.train(odd)).count() == 0


def test_exact_columns_on_odd_rows(spark, tmp_path, monkeypatch):
    for name, small in (("VOCAB_CHARS", 2000), ("SHARD_CHARS", 1000), ("GATHER", 50), ("MAPPED", 3)):
        monkeypatch.setattr(lm, name, small)
    rng = np.random.default_rng(4)
    letters = [*map(chr, range(0x30)), "A", "b", "\x85", "\xa0", "\u3000", "\u0130", "\xc9"]
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 200)))) for i in range(120)]
    rows += [(None, "a b"), (1, None), (2, ""), (2, " "), (-4, "A a"), (5, "x\0 x \0 \0\0"), (6, "w" * 5000), (2**63 - 1, "q"), (-(2**63), "R r")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in ((i, split(t)) for i, t in rows))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.op4_lm_scoring(spark, str(tmp_path)).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want] and [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-5)
