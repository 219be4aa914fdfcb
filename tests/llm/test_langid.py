import tracemalloc
import zlib

import numpy as np
import pytest

from accordia.llm import langid


def test_gradient():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    k, c = 3, 2
    w = {n: rng.normal(size=s) for n, s in (("uf", (9, 3)), ("ub", (9, 3)), ("ef", (9, 256)), ("eb", (9, 256)), ("of", (c, k)), ("ob", (c, k)), ("bias", (c,)))}
    x, truth = rng.integers(97, 101, size=(5, 4)), np.array([0, 1, 1, 0])

    def loss():
        out = {}
        for d, xs in (("f", x), ("b", x[::-1])):
            h, s = np.zeros((k, 4)), []
            for t in range(5):
                z, r, n, q = langid._step(w["u" + d], np.take(w["e" + d], xs[t], axis=1), h)
                h = n + z * (h - n)
                s.append(h)
            out[d] = np.array(s)
        logits = w["of"] @ out["f"] + (w["ob"] @ out["b"])[::-1] + w["bias"][:, None]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(p[:, truth, np.arange(4)]).mean()

    grad = langid._gradient(w, x, truth)
    for name in w:
        flat = w[name].reshape(-1)
        for i in rng.integers(0, flat.size, 6) if not name.startswith("e") else [256 * r + 98 for r in range(9)]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            # sums run in single precision
            assert grad[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=2e-3)


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_held_out_accuracy(model, local):
    held = [d for i, d in local.items() if zlib.crc32(str(i).encode()) % 4 == 2 and len(d.text) > 100]
    got = langid.predict(model, [d.text for d in held])
    assert np.mean([a == d.lang for (a, _), d in zip(got, held, strict=True)]) > 0.97
    assert all(0 <= s <= 1 for _, s in got)


def test_windows_don_t_depend_on_company(model):
    texts = ["The quick brown fox " * 40, "x", None, "12 ###", "Der schnelle braune Fuchs " * 300]
    alone = [langid.predict(model, [t])[0] for t in texts]
    for (a, s), (b, r) in zip(langid.predict(model, texts), alone, strict=True):
        assert a == b and s == pytest.approx(r, abs=1e-5)
    assert alone[2] == alone[3] == ("und", 0.0)


def test_positions_are_probabilities(model):
    raw = np.frombuffer("Ein kurzer Satz".encode(), np.uint8)
    p = langid.positions(model, raw, np.array([0]), np.array([len(raw)]))
    assert p.shape == (len(raw), len(model.languages), 1) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_scores_of_a_batch_keep_no_states(model):
    """What a batch of windows holds at its peak: bytes and class scores, but no states of all steps (16 MB for 1,024 windows)."""
    setup = langid.Setup()
    text = "Der schnelle braune Fuchs, the quick brown fox. " * (setup.batch * setup.window // 48)
    langid.predict(model, [text[:9000]])
    tracemalloc.start()
    try:
        langid.predict(model, [text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20


def test_both_cells_in_windows_of_unequal_length(model):
    """Against each window by itself, a byte at a time, by the step that training takes."""
    raw, w = np.frombuffer(("Zwölf Boxkämpfer " * 9).encode(), np.uint8), model.weights
    length = np.array([40, 40, 17, 3, 1])
    start = np.array([0, 5, 30, 2, 11])
    p = langid.positions(model, raw, start, length)
    for b, (s, n) in enumerate(zip(start, length, strict=True)):
        score = np.tile(w["bias"], (n, 1))
        for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            h = np.zeros((len(w["u" + d]) // 3, 1), np.float32)
            for t in order:
                z, _, c, _ = langid._step(w["u" + d], w["e" + d][:, raw[s + t : s + t + 1]], h)
                h = c + z * (h - c)
                score[t] += (w["o" + d] @ h)[:, 0]
        plain = np.exp(score - score.max(axis=1, keepdims=True))
        assert np.allclose(p[:n, :, b], plain / plain.sum(axis=1, keepdims=True), atol=1e-5)


def test_odd_rows(odd, empty, model):
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 5))
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert nothing.languages == [] and {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.filter_documents(odd).columns == odd.columns
    assert langid.filter_documents(empty).count() == 0


def test_query(spark, sf, local):
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert got.keys() == local.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_query_against_a_plain_network(spark, sf, docs, local):
    """The network once more, a byte and a cell at a time in double precision: the same languages and scores."""
    model = langid.fit(docs)
    w = {n: x.astype(float) for n, x in model.weights.items()}
    k = w["uf"].shape[1]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def run(direction, window):
        u, e, h, out = w["u" + direction], w["e" + direction], np.zeros(k), []
        for byte in window:
            a, x = u @ h, e[:, byte]
            z, r = sigmoid(a[:k] + x[:k]), sigmoid(a[k : 2 * k] + x[k : 2 * k])
            n = np.tanh(x[2 * k :] + r * a[2 * k :])
            h = z * h + (1 - z) * n
            out.append(w["o" + direction] @ h)
        return out

    def plain(text):
        raw, rows = text.encode(), []
        for at in range(0, len(raw), 256):
            window = raw[at : at + 256]
            for byte, f, b in zip(window, run("f", window), run("b", window[::-1])[::-1], strict=True):
                if byte >= 128 or chr(byte).isalpha():
                    p = np.exp(f + b + w["bias"])
                    rows.append(p / p.sum())
        mean = np.mean(rows, axis=0)
        return model.languages[int(mean.argmax())], mean.max()

    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    short = sorted(local, key=lambda i: len(local[i].text))[:120] + [max((i for i in local if len(local[i].text) < 20_000), key=lambda i: len(local[i].text))]
    for i in short:
        if not any(map(str.isalpha, local[i].text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        lang, score = plain(local[i].text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=2e-3)
