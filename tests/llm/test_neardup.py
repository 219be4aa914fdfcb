from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from accordia.llm import neardup


def bag(text):
    w = (text or "").encode().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)), strict=False))


def alike(a, b):
    both = sum((a & b).values())
    return 10 * both >= 8 * (sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """Least id of each row's class, all pairs compared."""
    bags = [bag(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (bags[i] == bags[j] or alike(bags[i], bags[j])):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least: dict = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or g in least else None
    return [least.get(g) for g in group]


def test_query(spark, sf, local):
    got = {r.doc_id: r.class_id for r in neardup.op6_minhash_near_dedup(spark, sf).collect()}
    rows = [(i, d.text) for i, d in local.items()]
    assert got == {i: c for (i, _), c in zip(rows, brute(rows), strict=True)}


@pytest.mark.parametrize("setup", [neardup.Setup(), neardup.Setup(block=3, block_elements=10**9), neardup.Setup(block=800, block_elements=400)])
def test_hot_groups(spark, setup):
    """Chains of copies whose ends differ, many copies of one text, and loners, in blocks of few documents."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(80)]
    rows, now = [], list(base)
    for k in range(40):
        rows.append((k, " ".join(now)))
        at = int(rng.integers(0, 80))
        now = [*now[:at], f"n{k}", *now[at + 1 :]]
    rows += [(100 + k, " ".join(base)) for k in range(50)]
    rows += [(200 + k, " ".join(f"l{k}_{j}" for j in range(30))) for k in range(5)]
    rows += [(300, "a b"), (301, "a  b"), (302, "b a"), (303, "x x x x x x x x"), (304, "x x x x x x x x x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs, setup).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute(rows), strict=True)}


def test_signatures_are_unbiased():
    """Matching slots follow the weighted Jaccard similarity of multisets."""
    rng, slots = np.random.default_rng(1), 4000
    a, b = rng.integers(0, 6, 30), rng.integers(0, 6, 30)
    ids = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    d = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
    sig = neardup.signatures(d, np.concatenate([ids[a > 0], ids[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, slots)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=4 * np.sqrt(0.25 / slots))


def test_shingles_are_multisets():
    d, s, c = neardup.shingles(pa.array(["a b c d e a b c d e", None, "", "x y", "a b c d e"]))
    assert d.tolist() == [0, 0, 0, 0, 0, 3, 4] and sorted(c.tolist()) == [1, 1, 1, 1, 1, 1, 2]
    assert s[6] in s[:5]
    sets = neardup.elements(d, s, c, 5)
    assert [len(x) for x in sets] == [6, 0, 0, 1, 1] and neardup.keys(sets)[1] == neardup.keys(sets)[2]


def test_odd_rows(spark, odd, empty):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count()
    by = Counter((r.doc_id, r.class_id) for r in got)
    assert by[1, 1] == 2 and by[3, 2] == by[2, 2] == by[5, 2] == 1 and by[None, 2] == 1 and by[7, 7] == 1
    named = {(r.doc_id, r.class_id) for r in got if r.class_id < 0}
    assert sorted(str(i) for i, _ in named) == ["7", "None"] and len({c for _, c in named}) == 2
    assert neardup.classes(empty).count() == 0 and neardup.filter_documents(empty).count() == 0
    kept = neardup.filter_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 4, 6, 7, 7, None])


def test_shared_and_missing_ids(spark):
    """Rows are told apart by their texts, whatever their ids; of each class one row stays, of equal rows one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    near = a.replace("a29", "z")
    rows = [(7, a), (7, c), (9, c), (3, b), (7, b), (None, near), (None, "d e f"), (None, "d e f"), (None, "g h i"), (7, a)]
    docs = spark.createDataFrame([(*r, "x", {"k": 1}) for r in rows], "doc_id long, text string, w string, hit map<string,int>").repartition(4)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows) and len({r.class_id for r in got}) == 5
    kept = Counter((r.doc_id, r.text) for r in neardup.filter_documents(docs).collect())
    assert kept == Counter([(7, a), (7, c), (3, b), (None, "d e f"), (None, "g h i")])


def test_one_hot_text_and_one_hot_bucket(spark, monkeypatch):
    """Joins that take every key of more than a few rows for a hot one give the same classes."""
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(300)]
    rows += [(1000 + k, " ".join([*base[: k % 50], f"n{k}", *base[k % 50 + 1 :]])) for k in range(200)]
    rows += [(2000 + k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 40))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(neardup, "HOT", 10**9)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs, neardup.Setup(block=50)).collect()}
    assert got == {i: (0 if i < 2000 else i) for i, _ in rows}


def test_filter_lets_the_wanted_through(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS w", "id % 7 = 0 AS want")
    got = neardup.found_in(rows, rows.where("want"), rows.where("want").count()).groupBy("want", "hit").count().collect()
    by = {(r.want, r.hit): r["count"] for r in got}
    assert by[True, True] == 715 and (True, False) not in by and by.get((False, True), 0) < 500
