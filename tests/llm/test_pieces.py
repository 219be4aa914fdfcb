import random
import zlib

import pyarrow as pa
import pytest

from accordia.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.MODEL)


def brute(model, s):
    arcs = model.arcs(s)

    def ways(end):
        if not end:
            return [(0, ())]
        return [(c + x, y + ids) for a, c, ids in arcs[end] for x, y in ways(a)]

    return sorted(c for c, _ in ways(len(s)))


def test_n_best_against_all(model):
    rnd = random.Random(5)
    for _ in range(150):
        t = "".join(rnd.choice(["the", "in", " ", "  ", "a", "é", "\n", "\U0001f600", "▁", "ing", "\t", "s."]) for _ in range(rnd.randint(0, 4)))
        got = model.text_n_best(t, 4)
        if t:
            assert [c for c, _ in got] == brute(model, " " + t)[:4]
            assert len({x for _, x in got}) == len(got)
        assert all(model.decode(x) == t for _, x in got)


def test_heuristic_is_exact(model):
    s = " international"
    least = model.forward(s)[0]
    assert [brute(model, s[:k])[0] for k in range(1, 9)] == least[1:9]


@pytest.mark.parametrize("t", ["9" * 100_000, "!" * 100_000, "我们在这里学习语言模型的训练数据处理方法" * 5_000, "東京都に住んでいます。" * 9_000])
def test_long_parts_without_pieces_across(model, t):
    got = model.text_n_best(t, 4)
    costs = [c for c, _ in got]
    assert costs[0] == model.forward(" " + t)[0][-1] and costs == sorted(costs)
    assert len({x for _, x in got}) == len(got) and all(model.decode(x) == t for _, x in got)


def test_side_by_side_is_one_by_one(model):
    """Forward passes in arrays give each part's own cost, ids and slack."""
    rnd = random.Random(8)
    parts = list({"".join(rnd.choice("theins.a é我\U0001f600▁９!'0") for _ in range(rnd.randint(1, 40))) for _ in range(3000)})
    model.memo.clear()
    assert model.bulk(parts) == [model.best(s) for s in parts]


def test_batches_are_texts(model):
    """A batch's rows are what each text gives by itself."""
    rnd = random.Random(9)
    texts = [None, "", " ", "\n", "x" * 3000, *("".join(rnd.choice(["the ", "in", " ", "  ", "a", "é", "\n", "\U0001f600", "▁", "ing", "\t", "s."]) for _ in range(rnd.randint(0, 60))) for _ in range(300))]
    got = pieces.encoded(model, pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)}), 4).to_pylist()
    for t, r in zip(texts, got, strict=True):
        best = model.text_n_best(t, 4)
        assert r["decoded"] and r["ids"] == best[0][1] and r["nbest_costs"] == [c for c, _ in best] and r["nbest_crc32"] == [zlib.crc32(x) for _, x in best]


def test_query(spark, sf, local, model):
    got = {r.doc_id: r for r in pieces.op3_sentencepiece_nbest(spark, sf).collect()}
    assert got.keys() == local.keys() and all(r.decoded for r in got.values())
    for i in list(local)[:20]:
        best = model.text_n_best(local[i].text, 4)
        assert got[i].nbest_costs == [c for c, _ in best] == sorted(got[i].nbest_costs)
        assert got[i].ids_crc32 == zlib.crc32(best[0][1]) and got[i].n_tokens == len(best[0][1]) // 4


def test_odd_rows(odd, empty):
    got = pieces.encode(odd).collect()
    assert len(got) == odd.count() and all(r.decoded for r in got)
    assert all(r.n_tokens == 0 and r.nbest_costs == [0] for r in got if r.doc_id in (2, 3))
    assert pieces.encode(empty).count() == 0
