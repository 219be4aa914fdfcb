from collections import Counter

import pytest

from accordia.llm import quality


def counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts(spark, sf, local):
    got = {r.doc_id: r for r in quality.op1_quality_rules(spark, sf).collect()}
    assert got.keys() == local.keys()
    for i, d in local.items():
        r, want = got[i], counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("text", ["a b c a b c a b c", "a a a a a", "a b c x a b c", "x\n\nx\n x\nx", None, "", "  \x1c a"])
def test_small_texts(text):
    assert quality.measure(text)[:5] == counts(text)


def test_binomial_tail():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 20, 0.3), (20, 20, 0.5)):
        assert quality.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_choose():
    """Of each rule the cutoff of most gain, the more lenient of equal ones; the rules by gain."""
    a, b = ("symbols", "+"), ("bangs", "+")
    counts = {a: [(0, 5), (0, 9), (1, 20), *[(0, 9)] * 8], b: [(0, 12), *[(1, 30)] * 7], ("marks", "-"): [(1, 20)] * 5}
    assert quality.choose(counts, quality.Risk()) == [(b, quality.RULES[b][0]), (a, quality.RULES[a][1])]


def test_certify():
    """Sets are tested one after another, and what comes behind one that fails isn't."""
    risk = quality.Risk(risk=0.01)
    assert quality.certify({"en": [2, 3, 60, 3]}, {"en": 2000}, risk, 1) == {"en": 2}
    assert quality.certify({"en": [0], "fr": [0], "de": []}, {"en": 300, "fr": 298}, risk, 1) == {"en": 1, "fr": 0, "de": 0}
    assert quality.certify({"en": [0]}, {}, risk, 1) == {"en": 0}


def test_false_rejections_stay_bounded():
    """Among many random holdouts, hardly any certifies rules whose true rate is above the bound, all strata together."""
    import numpy as np

    rng, wrong, risk = np.random.default_rng(3), 0, quality.Risk(risk=0.02)
    for _ in range(400):
        lost = {s: np.cumsum(rng.binomial(2000, [0.0201, 0.001, 0.002])).tolist() for s in "abc"}
        wrong += any(quality.certify(lost, dict.fromkeys("abc", 2000), risk, 3).values())
    assert wrong <= 400 * 0.05 + 3 * (400 * 0.05) ** 0.5


def test_cutoffs_in_every_stratum(spark):
    """Junk is told by symbols in one language and by marks in the other; the SQL agrees with the query on all rows."""
    import duckdb

    rows, labels = [], []
    for k in range(2400):
        lang, bad = ("en", "fr")[k % 2], k % 6 > 3
        words = [f"word{(k * 7 + j) % 977}x{j}" + ("," if j % 9 == 0 and not (bad and lang == "fr") else "") for j in range(60)]
        if bad and lang == "en":
            words[::3] = ["###"] * 20
        rows.append((k, " ".join(words), lang))
        labels.append((k, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(docs, marks).toPandas()
    assert all(k == (i % 6 <= 3) for i, k in zip(got.doc_id, got.kept, strict=True))
    assert got[~got.kept].groupby(got.doc_id % 2).rejected_by.nunique().to_dict() == {0: 1, 1: 1}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", marks.toPandas())
    want = con.execute(quality.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    got = got.sort_values("doc_id").reset_index(drop=True)
    assert want[got.columns].astype(str).replace("nan", "None").equals(got.astype(str).replace("nan", "None"))
    assert {r.doc_id for r in quality.filter_documents(docs, marks).collect()} == set(got.doc_id[got.kept])


def test_odd_rows(odd, empty, labels):
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count() and sum(r.n_words == 0 for r in got) == 4
    assert quality.judge(empty, labels).count() == 0 and quality.filter_documents(empty, labels).count() == 0
    assert quality.judge(odd, labels.limit(0)).count() == odd.count()
    kept = quality.filter_documents(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {4}


def test_filter_agrees(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
