"""Every registered query with SQL beside it, Spark against DuckDB on the same tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from accordia.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if isinstance(v, float | np.floating):
            return None if np.isnan(v) else round(float(v), 5) + 0.0
        if isinstance(v, np.bool_ | bool):
            return bool(v)
        return float(v) if isinstance(v, int | np.integer) else None if v is None or str(v) == "<NA>" else str(v)

    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_codebleu_of_all_pairs(spark, sf):
    from accordia.functions import codebleu
    from accordia.plans import facts

    added = {(r.issue, r.t): r.added for r in facts.tables(spark, sf, "candidate")["candidate"].collect()}
    got = {(r.issue, r.i, r.j): r.codebleu for r in QUERIES["codebleu_pairs"](spark, sf).collect()}
    assert got.keys() == {(issue, i, j) for issue, j in added for i in range(j)}
    for issue, i, j in sorted(got)[:600]:
        a, b = added[issue, i], added[issue, j]
        assert abs(got[issue, i, j] - (codebleu.score(a, b) + codebleu.score(b, a)) / 2) < 1e-6


def test_components_against_search(spark, sf):
    from accordia.plans import facts

    made = facts.tables(spark, sf, "label")
    pairs: dict = {}
    for r in made["pair"].where("valid").collect():
        pairs.setdefault(r.issue, {})[r.i, r.j] = r.score
    members: dict = {}
    for r in made["candidate"].where("valid").collect():
        members.setdefault(r.issue, []).append(r.t)
    want = set()
    for issue, ts in members.items():
        for t10 in range(1, 10):
            seen: dict = {}
            for t in sorted(ts):
                if t in seen:
                    continue
                cid, todo = len(set(seen.values())), [t]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen[x] = cid
                        todo += [y for y in ts if y != x and pairs[issue][min(x, y), max(x, y)] >= t10 / 10]
            want |= {(issue, t10, t, c) for t, c in seen.items()}
    assert {tuple(r) for r in made["label"].select("issue", "t10", "t", "cid").collect()} == want


def test_invariants(spark, sf):
    r = QUERIES["invariants"](spark, sf).first()
    assert r.bad_sizes == 0 and r.above_oracle == 0
    frame = QUERIES["cluster_structure"](spark, sf)
    assert frame.where("singles + multi <> k OR fulls > 1 OR k > n").count() == 0
    pattern = QUERIES["size_pattern"](spark, sf).join(frame, ["issue", "t10"])
    assert pattern.where("aggregate(transform(split(pattern, '[|]'), x -> cast(x AS int)), 0, (a, x) -> a + x) <> n").count() == 0


def test_bootstrap_mean_is_inside(spark, sf):
    for r in QUERIES["bootstrap_ci"](spark, sf).where("low IS NOT NULL").collect():
        assert r.low <= r.mean + 1e-9 and r.mean - 1e-9 <= r.high and r.text.startswith("[")


def test_own_candidates(spark, tmp_path):
    """Components by transitivity, patterns, densities and selections of a case worked out by hand."""
    from accordia.plans.study import Study

    cells = spark.createDataFrame([("i1", t, f"w{t} x y z", s, 1) for t, s in enumerate(("1", " 1.0 ", "0", "0"))] + [("i2", 0, "a", "MISSING", 1)], "issue string, t int, added string, status string, syntax int")
    scores = spark.createDataFrame([("i1", 0, 1, 0.9), ("i1", 1, 2, 0.7), ("i1", 0, 2, 0.1), ("i1", 0, 3, 0.2), ("i1", 1, 3, 0.2), ("i1", 2, 3, 0.2)], "issue string, i int, j int, score double")
    s = Study(spark, cells, scores)
    pattern = {r.t10: r.pattern for r in s.report("size_pattern").collect()}
    assert (pattern[9], pattern[7], pattern[2]) == ("2|1|1", "3|1", "4")
    frag = {r.t10: r.fragmentation for r in s.report("fragmentation").collect()}
    assert (frag[9], frag[7], frag[2]) == (0.833333, 0.5, 0.0)
    big = s.report("confusion").where("t10 = 7 AND size = 3").first()
    assert (big.tp, big.fp, big.fn, big.tn, big.f1, big.mcc) == (2, 1, 0, 1, 0.8, 0.57735)
    assert s.report("density").where("t10 = 7 AND size = 3").first().density == 0.566667
    assert s.report("roc_auc").where("t10 = 7 AND cid = 0").first().roc_auc == 1.0
    assert s.report("avg_precision").where("t10 = 7 AND cid = 0").first().pr_auc == 1.0
    far = s.table("selection").where("strategy = 'singleton_furthest' AND t10 = 9").first()
    assert far.cid == 2 and s.table("selection").where("strategy = 'smallest'").count() == 0
    assert s.report("winner_ties").count() > 0
    s.write(str(tmp_path), ["avg_f1", "rq1_prevalence"])
    assert (tmp_path / "avg_f1").exists()
    from accordia.sources.files import latex_table

    assert latex_table(s.report("avg_f1"), "strategy", ["t9"]).count("&") >= 3


def partition(spark, sizes, passing, name="i"):
    """A study of one issue whose candidates fall into clusters of these sizes, in order, at every threshold."""
    from accordia.plans.study import Study

    of = [k for k, n in enumerate(sizes) for _ in range(n)]
    cells = spark.createDataFrame([(name, t, f"w{t}", "1" if t in passing else "0", 1) for t in range(len(of))], "issue string, t int, added string, status string, syntax int")
    scores = spark.createDataFrame([(name, i, j, 1.0 if of[i] == of[j] else 0.0) for j in range(len(of)) for i in range(j)], "issue string, i int, j int, score double")
    return Study(spark, cells, scores)


def groups(study):
    study.report("rq2_counts").count()
    return {(r.definition, r.grp): (r.size, r.tp) for r in study.spark.table("groups").where("t10 = 5").collect()}


def test_oracle_takes_ids_in_the_order_of_strings(spark):
    s = partition(spark, [1] * 11, {2, 10})
    got = s.table("selection").where("t10 = 5 AND strategy = 'oracle'").first()
    assert got.cid == 10 and round(got.f1, 6) == 0.666667


def test_majority_needs_more_than_half_and_a_separation(spark):
    for sizes, there in (([5, 1, 1, 1, 1, 1], False), ([6, 1, 1, 1, 1], True), ([5, 1, 1, 1, 1, 1, 1], False), ([6, 1, 1, 1, 1, 1], True), ([11], False)):
        assert (("1-Majority", "majority") in groups(partition(spark, sizes, {0}))) == there, sizes


def test_minority_under_both_definitions(spark):
    got = groups(partition(spark, [4, 1, 1, 1, 1, 1, 1, 1], {0, 1, 2, 5, 6}))
    assert got["1-Majority", "minority"] == (4, 3) and ("1-Majority", "majority") not in got
    assert got["2-Largest", "majority"] == (4, 3) and ("2-Largest", "minority") not in got and got["2-Largest", "disagreement"] == (7, 2)
    s = partition(spark, [4, 1, 1, 1, 1, 1, 1, 1], {0, 1, 2, 5, 6})
    a = s.report("advantage_long").where("t10 = 5 AND size = 4").first()
    assert (a.hit, a.baseline, a.advantage) == (75.0, 45.454545, 29.545455)
    u = s.report("utility_by_issue").where("strategy = 'largest'").first()
    assert u.t5 == 0.636364
    assert s.table("selection").where("strategy = 'largest' AND t10 = 5").selectExpr("round(precision * (1 - size / n), 6) AS u").first().u == 0.477273


def test_one_singleton_is_disagreement_but_no_union(spark):
    s = partition(spark, [10, 1], {0})
    assert ("1-Majority", "disagreement") in groups(s)
    assert s.table("selection").where("strategy = 'singleton_union'").count() == 0
    whole = partition(spark, [3], {0})
    assert whole.report("utility_by_issue").where("strategy = 'largest'").first().t5 is None


def test_all_singletons_count_for_coverage_only(spark):
    s = partition(spark, [1] * 11, {4})
    got = {(r.definition, r.grp): r.t5 for r in s.report("rq2_coverage").collect()}
    assert got["1-Majority", "disagreement"] == 1.0 and s.report("rq3_gain").count() == 0 and s.report("rq1_prevalence").count() == 0


def test_odds_interval_and_chosen_threshold(spark):
    from accordia.plans import reports

    spark.createDataFrame([("x", 9, 10, 5, 4, 8), ("x", 8, 0, 5, 4, 8)], "definition string, t10 int, a long, b long, c long, d long").createOrReplaceTempView("tables2x2")
    for name in ("fisher", "odds"):
        spark.sql(reports.spell(reports.DERIVED[name], True)).createOrReplaceTempView(name)
    got = {r.t10: r for r in spark.sql(reports.REPORTS["rq1_or_ci"]).collect()}
    assert (got[9].corrected_ratio, got[9].low, got[9].high) == (4.0, 0.799331, 20.016743)
    assert got[8].corrected_ratio == round(0.5 * 8.5 / (5.5 * 4.5), 6)
    from math import comb

    p = {k: comb(15, k) * comb(12, 14 - k) / comb(27, 14) for k in range(2, 15)}
    assert spark.table("fisher").where("t10 = 9").first().p_value == pytest.approx(sum(v for v in p.values() if v <= p[10] * (1 + 1e-7)))
    rows = lambda *x: spark.createDataFrame([("x", t, pv, None, r) for t, pv, r in x], "definition string, t10 int, p_value double, odd string, ratio double").createOrReplaceTempView("odds")
    rows((3, 0.01, 2.0), (6, 0.01, 2.0), (9, 0.9, 9.0))
    assert spark.sql(reports.REPORTS["rq1_tstar"]).first().t10 == 6
    rows((3, 0.2, 9.0), (6, 0.2, 2.0), (7, 0.2, 3.0))
    assert spark.sql(reports.REPORTS["rq1_tstar"]).first().t10 == 7


def test_log_factorials(spark):
    from math import lgamma

    from accordia.plans import reports

    for n, v in spark.range(1, 400).selectExpr("id", reports.spell("LF[id]", True)).collect():
        assert v == pytest.approx(lgamma(n + 1), rel=1e-12, abs=1e-10)


def test_threshold_intervals_by_hand(spark, sf):
    """Seeds by the place of the number of passing candidates and of the threshold; values in issue order, not rounded."""
    got = {(r.passing, r.t10): r for r in QUERIES["subgroup_threshold_ci"](spark, sf).collect()}
    rows = spark.table("gaps").selectExpr("m", "t10", "issue", "agree - uni AS d").toPandas()
    numbers = sorted({r.m for r in spark.table("issue").where("subset = 'solvable'").collect()})
    for (m, t10), own in rows.groupby(["m", "t10"]):
        v = own.sort_values("issue").d.to_numpy()
        if len(v) < 2:
            assert got[m, t10].text == "NA"
            continue
        rng = np.random.default_rng(20260819 + 10000 * (numbers.index(m) + 1) + t10 - 1)
        low, high = np.percentile([v[rng.integers(0, len(v), size=len(v))].mean() for _ in range(10_000)], [2.5, 97.5])
        assert got[m, t10].text == f"[{low:.4f}, {high:.4f}]"
        if len(v) > 3:
            break


def test_lookup_of_an_unknown_instance(spark):
    from accordia.sources import files

    cells = spark.createDataFrame([(" a ", 1), ("b", 2)], "instance_id string, t int")
    known = spark.createDataFrame([("a", "r"), ("b", "s"), ("b", "s")], "instance_id string, repo string")
    assert [r.repo for r in files.lookup(cells.where("t = 1"), known, ["repo"]).collect()] == ["r"]
    for bad in (cells, spark.createDataFrame([("c", 3)], "instance_id string, t int")):
        with pytest.raises(Exception, match="no instance or several"):
            files.lookup(bad, known, ["repo"]).collect()
