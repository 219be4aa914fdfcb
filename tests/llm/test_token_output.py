import random
import zlib

import numpy as np
import pytest

from accordia.llm import common, pfor
from accordia.llm import token_output as t
from accordia.llm.bpe import encoder

ALPHABET = ["a", "B", " ", "  ", "\n", ".", ",", "'s", "1", "é", "\t", "́", "#", "\r", "\x1c", "\x85", "　", "İ", "Σ", "²", "ª", "अ", "ि", "\U0001f600", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_changes_no_id(name):
    e, rnd = encoder(name), random.Random(2)
    texts = ["", " ", None, "it's  ok ", "we'll 'sabc ''s !'s\n's  's l'été 'ré ÉÀß×÷ d'12'34\t 'll", "\0 a\0b", "x" * 100_000, *("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 14))) for _ in range(1500)), *("".join(rnd.choice(ALPHABET[:13]) for _ in range(rnd.randint(1, 30))) for _ in range(1500))]
    assert e.encode_many(texts) == [e.whole(x or "") for x in texts]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50, n).astype("<u4")
    ids[rng.random(n) < 0.05] = rng.integers(0, 1 << 32, int((rng.random(n) < 2).sum()))[: int((ids >= 0).sum())][: (rng.random(n) < 2).sum()][0] if n else 0
    starts, raw = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(starts, raw, n) == ids).all()
    data = pfor.pack_file(ids, [None, 7], np.array([n // 2, n - n // 2]))
    back, keys, lengths = pfor.unpack_file(data)
    assert (back == ids).all() and keys == [None, 7] and lengths.sum() == n
    mapped = np.frombuffer(data, np.uint8)
    for a, k in ((0, 5), (100, 60), (n - 3 if n > 3 else 0, 9), (n + 5, 3)):
        assert (pfor.slice_ids(mapped, a, k) == ids[a : a + k]).all()


def test_extreme_blocks():
    for ids in (np.full(128, 2**32 - 1), np.array([0, 2**32 - 1] * 64), np.arange(128) << 24):
        ids = ids.astype("<u4")
        for q in (1, 50, 90, 100):
            assert (pfor.decode_blocks(*pfor.encode_blocks(ids, q), len(ids)) == ids).all()
    with pytest.raises(ValueError, match="not a file"):
        pfor.unpack_file(bytes(64))


def test_query(spark, sf, local):
    e, at = encoder(t.TOKENIZER), 0
    got = {r.doc_id: r for r in t.op5_token_output(spark, sf).collect()}
    assert got.keys() == local.keys()
    for i in sorted(local):
        raw = e.whole(local[i].text) + np.array([t.END], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4


def run(spark, docs, **more):
    return t.read_tokens(t.with_bases(common.settle(t.write_tokens(docs, common.shared_dir(spark, "t"), **more), "m"))).collect()


def test_odd_rows(spark, odd, empty):
    got = sorted(run(spark, odd, file_ids=50), key=lambda r: r.start)
    assert len(got) == odd.count()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert sum(r.n_tokens == 1 for r in got) == 4
    assert run(spark, empty) == []
