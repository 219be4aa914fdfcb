"""The pair kernel against counting, and how the fact tables are made."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from accordia.functions import codebleu, diffs, pairs, text
from accordia.operators import conversion, patches
from accordia.plans import catalog, facts, more
from accordia.plans.study import Study

WHITE = " \t\n\x0b\x0c\r"


def split(s):
    return "".join(" " if c in WHITE else c for c in s or "").split(" ") if s else []


def plain(a, b):
    a, b = ([w for w in split(x) if w] for x in (a, b))
    if not a or not b:
        return float(not a and not b)
    grams = [[Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for n in range(1, 5)] for x in (a, b)]
    m = [sum((x & y).values()) for x, y in zip(*grams, strict=True)]

    def one(c, r):
        return 0 if not m[0] else (1 if c > r else math.exp(1 - r / c)) * math.exp(sum(math.log((v or 0.1) / max(1, c - n)) for n, v in enumerate(m)) / 4)

    return (one(len(a), len(b)) + one(len(b), len(a))) / 2


def some(rng, n):
    return [rng.choice([None, "", " ", "a\xa0b c\x85d", "x\x0by\x1cz"]) if rng.random() < 0.1 else "".join(f"{w}{rng.choice([' ', '  ', chr(9)])}" for w in rng.integers(0, 5, rng.integers(0, 30))) for _ in range(n)]


def test_counts_against_counting(spark, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS", 20)  # issues that go on in another batch
    rng = np.random.default_rng(1)
    rows = [(None, 0, "a", True), (None, 1, "a", True)] + [(k, t, s, bool(t % 3)) for k in range(30) for t, s in enumerate(some(rng, int(rng.integers(1, 14))))] + [(99, t, s, True) for t, s in enumerate(some(rng, 90))]
    df = spark.createDataFrame(rows, "issue long, t int, added string, valid boolean")
    got = {(r.issue, r.i, r.j): (r.valid, r.score) for r in pairs.counted(df).selectExpr("*", f"{text.symmetric('la', 'lb')} AS score").collect()}
    by = {}
    for k, t, s, ok in rows[2:]:
        by.setdefault(k, []).append((t, s, ok))
    want = {(k, i, j): (x and y, plain(a, b)) for k, own in by.items() for (i, a, x), (j, b, y) in combinations(own, 2)}
    assert got.keys() == want.keys()
    for k, (ok, score) in want.items():
        assert got[k][0] == ok and got[k][1] == pytest.approx(score, abs=1e-6)


def test_file_scores_against_counting(spark):
    rng = np.random.default_rng(2)
    rows = [(k, t, f, *some(rng, 2)) for k in range(12) for t in range(-1, 5) for f in "fgh" if rng.random() < 0.7]
    rows += [(1, 0, None, "a", "b"), (None, 0, "f", "a", "b"), (None, 1, "f", "a", "b")]
    df = spark.createDataFrame(rows, "issue int, t int, file string, removed string, added string")
    by = {}
    for k, t, f, a, b in rows:
        by.setdefault((k, t), {})[f] = (a, b)

    def blank(s):
        return not [w for w in split(s) if w]

    def check(got, wanted):
        want = {(k, i, j) for k, i in by for m, j in by if k == m and k is not None and wanted(i, j)}
        assert {(r.issue, r.i, r.j) for r in got} == want
        for r in got:
            x, y = by[r.issue, r.i], by[r.issue, r.j]
            each = []
            for f in x.keys() & y.keys() - {None}:
                s = [plain(a, b) for a, b in zip(x[f], y[f], strict=True) if not (blank(a) and blank(b))]
                each.append(sum(s) / len(s) if s else 0.0)
            union = len((x.keys() | y.keys()) - {None})
            assert r.main == pytest.approx(sum(each) / union, abs=1e-5) and r.jaccard == pytest.approx(len(each) / union)

    check([r for r in patches.decomposition(df.where("t >= 0")).collect()], lambda i, j: 0 <= i < j)
    check([r for r in patches.decomposition(df.where("t >= 0"), df.where("t = -1").drop("t")).collect()], lambda i, j: i == -1 and j >= 0)


def test_no_table_is_broadcast_for_its_files(spark, sf, monkeypatch):
    plans, settle = [], facts.settle
    monkeypatch.setattr(facts, "settle", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), settle(df, name))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).selectExpr("doc_id AS issue", "explode(sequence(0, 5)) AS t", "text AS added", "'1' AS status", "1 AS syntax")
    study = Study(spark, docs)
    for name in ("advantage_by_size", "rq1_tstar", "matched_oracle", "invariants"):
        plans.append((name, study.report(name)._jdf.queryExecution().executedPlan().toString()))
    assert {"pair", "cluster", "selection"} <= {n for n, _ in plans}
    assert [n for n, p in plans if "BroadcastHashJoin" in p] == []
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_reports_on_candidates_make_no_pairs(spark, sf, monkeypatch):
    made, settle = [], facts.settle
    monkeypatch.setattr(facts, "settle", lambda df, name: (made.append(name), settle(df, name))[1])
    study = Study(spark, facts.candidates(spark, sf).drop("valid"))
    for name in ("pass_histogram", "missing_cells", "repo_totals", "solvable_partition"):
        assert study.report(name).count()
    assert made == ["candidate"]


def test_candidates_have_the_first_words(spark, tmp_path):
    texts = ["  " + " ".join(map(str, range(60))), "\x0b1\t2\n", " ".join(map(str, range(24))), " ".join(map(str, range(25))), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'r' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.issue: r.removed for r in facts.candidates(spark, str(tmp_path)).where("t = 0").collect()}
    assert got == {i: s if s is None else " ".join([w for w in split(s) if w][:24]) for i, s in enumerate(texts)}


def test_whole_documents_once_shuffled(spark, tmp_path):
    texts = ["a\xa0b c\x85d e f g h", " ".join(map(str, range(300))), "", None, "one"]
    spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string").selectExpr("*", "'r' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    df = more.q_whole(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    own = {}
    for r in spark.sql(facts.WHOLE.replace("FROM documents", f"FROM parquet.`{tmp_path}/documents.parquet`")).collect():
        own.setdefault(r.issue, {})[r.t] = r.added
    got = {(r.issue, r.i, r.j): r.score for r in df.collect()}
    assert len(got) == 55 * len(texts)
    for (k, i, j), score in got.items():
        assert score == pytest.approx(plain(own[k][i], own[k][j]), abs=1e-6)


def test_changed_lines_like_headers(spark, tmp_path):
    assert diffs.parse("diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n keep\n--- x\x85y\n+++ z\n@@ -9 +9 @@\n---q\n+++\n") == [("f", "-- x\x85y\n--q", "++ z\n++")]
    texts = ["-- a b", "++ a b", "--- a", "@@ -1 +1 @@", "a\x1cb c d", "diff --git a/x b/x"]
    spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string").selectExpr("*", "'r' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.issue, r.t): r.changed for r in catalog.queries()["changed_text"](spark, str(tmp_path)).collect()}
    want = {}
    for r in more.patch_files(spark, str(tmp_path)).orderBy("file").collect():
        want.setdefault((r.issue, r.t), []).extend(x for x in (r.removed, r.added) if x.strip())
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_clusters_take_one_shuffle_and_no_join(spark, sf, monkeypatch):
    plans, settle = {}, facts.settle
    monkeypatch.setattr(facts, "settle", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), settle(df, name))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).selectExpr("doc_id AS issue", "explode(sequence(0, 5)) AS t", "text AS added", "'1' AS status", "1 AS syntax")
    Study(spark, docs).table("selection")
    assert {n: p.count("Exchange") for n, p in plans.items() if n in ("cluster", "selection")} == {"cluster": 1, "selection": 0}
    assert [n for n in ("cluster", "selection", "pair") if "Join" in plans[n]] == []


def test_clusters_of_few_and_missing_pairs(spark):
    """Twelve candidates, of which five have pairs: a missing pair is no link, and counts in no mean."""
    rows = [(1, t, f"x{t}", "1" if t in (0, 3) else "0", int(t != 4)) for t in range(12)] + [(2, 7, "y", "1", 1), (3, 0, "z", "1", 0)]
    df = spark.createDataFrame(rows, "issue long, t int, added string, status string, syntax int")
    scores = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.5), (1, 0, 2, None), (1, 2, 3, 0.1), (1, 0, 4, 1.0)], "issue long, i int, j int, score double")
    study = Study(spark, df, scores)
    at5 = {(r.issue, r.t): r.cid for r in study.table("label").where("t10 = 5").collect()}
    assert at5 == {(1, t): max(0, t - 2 - (t > 4)) for t in range(12) if t != 4} | {(2, 7): 0}
    got = {(r.issue, r.t10, r.cid): r for r in study.table("cluster").collect()}
    r = got[1, 5, 0]
    assert (r.n, r.m, r.size, r.tp, r.fp, r.fn, r.tn, r.k, r.multi, r.subset) == (11, 2, 3, 1, 2, 1, 7, 9, 1, "solvable")
    assert (r.density, r.precision, r.recall) == (0.7, round(1 / 3, 9), 0.5)
    # reach: candidate 0: (1 + 0.9) / 2, 1: (0.9 + 1 + 0.5) / 3, 2: (0.5 + 1) / 2, 3: 0.1; others aren't seen
    assert (r.roc_auc, r.pr_auc) == (round((4 + 1 - 3) / 4, 9), round((1 + 2 / 4) / 2, 9))
    assert got[2, 9, 0].density == 1.0 and not any(k == 3 for k, _, _ in got)
    union = study.table("selection").where("strategy = 'singleton_union' AND issue = 1 AND t10 = 5").collect()
    assert [(r.size, r.tp, r.k) for r in union] == [(8, 1, 9)]


def test_reports_make_only_what_they_read(spark, sf, monkeypatch):
    plans, settle = {}, facts.settle
    monkeypatch.setattr(facts, "settle", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), settle(df, name))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).selectExpr("doc_id AS issue", "explode(sequence(0, 5)) AS t", "text AS added", "'1' AS status", "1 AS syntax")
    study = Study(spark, docs)
    assert study.report("confusion").count()
    assert list(plans) == ["candidate", "pair", "cluster"]
    tstar = study.report("rq1_tstar")
    assert list(plans) == ["candidate", "pair", "cluster", "selection"] and plans["selection"].count("FileScan") == 2
    assert tstar.inputFiles() and all("/tables2x2-" in f for f in tstar.inputFiles())


def test_codebleu_side_by_side(spark, tmp_path):
    import pyarrow as pa

    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["", " \n", "if x in y", "if  x in x in y", "a = b\nc = a + b", "a = b\nc = b", "x", "return return 1", "".join(f"w{k}{c}" for k, c in enumerate(white)), " ".join(f"w{k}" for k in range(len(white))), "a\x1cb", "a b", "d = e\nf = d"]
    size = np.array([9, 1, 3])
    got, (x, y, _) = codebleu.scores(pa.array(texts, pa.large_string()), np.repeat([0, 1, 2], size), size, "python"), pairs.squares(size)
    for a, b, s in zip(x.tolist(), y.tolist(), got, strict=True):
        a, b = texts[a], texts[b]
        want = (codebleu.score(a, b) + codebleu.score(b, a)) / 2 if a.strip() and b.strip() else float(a.strip() == b.strip())
        assert s == pytest.approx(want, abs=1e-12), (a, b)
    spark.createDataFrame(list(enumerate(texts)) + [(None, "a b")], "doc_id long, text string").selectExpr("*", "'r' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["codebleu_pairs"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and df.count() == 55 * len(texts)


def test_answers_are_converted_without_joins(spark, monkeypatch):
    edit = "<edits><edit><file>{}</file><replace_this>{}</replace_this><with_this>{}</with_this></edit></edits>"
    rows = [(1, t, edit.format("a.py", "x = 1", f"x = {t % 2}")) for t in range(4)] + [(1, 4, None), (2, 0, edit.format("a.py", "x", "y")), (None, 0, edit.format("a.py", "x = 1", "x = 2")), (3, 0, edit.format("b.py", "q", "r"))]
    answers = spark.createDataFrame(rows, "issue int, t int, answer string")
    files_ = [(1, "a.py", "x = 1\n"), (1, "a.py", None), (1, "b.py", "z\n"), (None, "a.py", "x = 1\n"), (3, "b.py", "a\nq\n"), (3, "b.py", "b\nq\n"), (9, "a.py", "x\n")]
    df = conversion.predictions(answers, spark.createDataFrame(files_, "issue int, path string, content string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    held = {1: {"a.py": "x = 1\n", "b.py": "z\n"}, 3: {"b.py": "b\nq\n"}}
    assert {(r.issue, r.t): (r.patch, r.syntax, r.kinds) for r in df.collect()} == {(k, t): conversion.convert(a, held.get(k)) for k, t, a in rows}
