"""Reports over the fact tables, in SQL that Spark and DuckDB both read.

LISTAGG[x; order] stands for joining strings by | in that order, which the two spell differently.
"""

from __future__ import annotations

import re

STRATEGIES = ("largest", "smallest", "singleton_union", "singleton_furthest")
#: Below this many issues a mean is left out.
SUPPORT = 10

#: Small constant tables, so that cells without an issue have their row.
TENTHS = " UNION ALL ".join(f"SELECT {t} AS t10" for t in range(1, 10))
ALL_WAYS = ("largest", "smallest", "densest", "oracle", "oracle_roc_auc", "singleton_furthest", "singleton_union")
WAYS7 = " UNION ALL ".join(f"SELECT '{s}' AS strategy" for s in ALL_WAYS)
HALVES = "SELECT 'solvable' AS subset UNION ALL SELECT 'nonsolvable' AS subset"
KINDS3 = " UNION ALL ".join(f"SELECT '{g}' AS grp" for g in ("majority", "minority", "disagreement"))
#: Mean advantage of clusters of two or more, and that of the union of singletons, where an issue has both.
GAPS = """
SELECT issue, t10, m, agree, 100e0 * st / sc - 100e0 * m / n AS uni FROM (SELECT issue, t10, max(n) AS n, max(m) AS m, avg(CASE WHEN size >= 2 THEN 100e0 * tp / size - 100e0 * m / n END) AS agree,
  sum(CASE WHEN size = 1 THEN tp END) AS st, sum(CASE WHEN size = 1 THEN 1 END) AS sc FROM cluster WHERE subset = 'solvable' GROUP BY issue, t10) x WHERE agree IS NOT NULL AND sc IS NOT NULL
"""
DEFS = "SELECT '1-Majority' AS definition UNION ALL SELECT '2-Largest' AS definition"
#: Majority, minority and disagreement groups of each issue and threshold under both definitions.
GROUPS = """
SELECT d.definition, s.issue, s.subset, s.n, s.m, s.k, s.t10, 'majority' AS grp, s.size, s.tp FROM selection s CROSS JOIN defs d WHERE s.strategy = 'largest' AND s.size < s.n AND (d.definition = '2-Largest' OR 2 * s.size > s.n)
UNION ALL SELECT d.definition, s.issue, s.subset, s.n, s.m, s.k, s.t10, 'minority' AS grp, s.size, s.tp FROM selection s CROSS JOIN defs d WHERE s.strategy = 'smallest' AND s.size < s.n
UNION ALL SELECT '1-Majority' AS definition, s.issue, s.subset, s.n, s.m, s.k, s.t10, 'minority' AS grp, s.size, s.tp FROM selection s WHERE s.strategy = 'largest' AND s.multi = 1 AND s.size < s.n AND 2 * s.size <= s.n
UNION ALL SELECT d.definition, c.issue, c.subset, c.n, c.m, c.k, c.t10, 'disagreement' AS grp, cast(sum(c.size) AS int) AS size, cast(sum(c.tp) AS int) AS tp FROM cluster c CROSS JOIN defs d WHERE c.size = 1 GROUP BY d.definition, c.issue, c.subset, c.n, c.m, c.k, c.t10
"""
#: One row per issue and threshold.
FRAME = """
SELECT issue, subset, n, m, t10, k, multi, cast(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS int) AS singles,
  cast(sum(CASE WHEN size = n THEN 1 ELSE 0 END) AS int) AS fulls,
  CASE WHEN n <= 1 THEN 0e0 ELSE round(greatest(0e0, least(1e0, 1 - sum(size * (size - 1)) / (1e0 * n * (n - 1)))), 9) END AS fragmentation,
  LISTAGG[cast(size AS varchar(9)); size DESC] AS pattern
FROM cluster GROUP BY issue, subset, n, m, k, multi, t10
"""
#: Gains over random choice, where the partition separates: 1 < k < n.
CASES = """
SELECT definition, issue, t10, n, m, grp, CASE WHEN tp > 0 THEN 1 ELSE 0 END AS correct, round(100e0 * tp / size - 100e0 * m / n, 9) AS gain FROM groups WHERE subset = 'solvable' AND k > 1 AND k < n
"""
#: Whether a majority exists, over structurally valid thresholds.
PREVALENCE = """
WITH g AS (SELECT definition, issue, t10 FROM groups WHERE grp = 'majority')
SELECT d.definition, f.subset, f.t10, cast(count(*) AS bigint) AS valid_issues, cast(sum(CASE WHEN g.issue IS NOT NULL THEN 1 ELSE 0 END) AS bigint) AS with_majority
FROM frame f CROSS JOIN defs d LEFT JOIN g ON g.definition = d.definition AND g.issue = f.issue AND g.t10 = f.t10
WHERE f.subset IS NOT NULL AND f.k > 1 AND f.k < f.n GROUP BY d.definition, f.subset, f.t10
"""
#: Two-by-two tables, majority or not by solvable or not.
TABLES2X2 = """
SELECT definition, t10, cast(coalesce(sum(CASE WHEN subset = 'solvable' THEN with_majority END), 0) AS bigint) AS a, cast(coalesce(sum(CASE WHEN subset = 'solvable' THEN valid_issues - with_majority END), 0) AS bigint) AS b,
  cast(coalesce(sum(CASE WHEN subset = 'nonsolvable' THEN with_majority END), 0) AS bigint) AS c, cast(coalesce(sum(CASE WHEN subset = 'nonsolvable' THEN valid_issues - with_majority END), 0) AS bigint) AS d
FROM prevalence GROUP BY definition, t10
"""
#: Two-sided exact test: all tables of the same margins that are no likelier. SERIES and LF (ln of a factorial) are spelled by dialect.
FISHER = """
WITH w AS (SELECT t.*, a + b AS r1, c + d AS r2, a + c AS c1, a + b + c + d AS n FROM tables2x2 t),
y AS (SELECT w.*, SERIES[greatest(0, c1 - r2); least(r1, c1); 65536] AS low FROM w),
x AS (SELECT y.*, SERIES[low; least(low + 65535, least(r1, c1)); 1] AS x FROM y),
p AS (SELECT definition, t10, a, x, LF[r1] + LF[r2] + LF[c1] + LF[n - c1] - LF[n] - LF[x] - LF[r1 - x] - LF[c1 - x] - LF[r2 - c1 + x] AS lp FROM x),
s AS (SELECT definition, t10, max(CASE WHEN x = a THEN lp END) AS at_seen FROM p GROUP BY definition, t10)
SELECT p.definition, p.t10, least(1e0, sum(CASE WHEN p.lp <= s.at_seen + 1e-7 THEN exp(p.lp) ELSE 0e0 END)) AS p_value FROM p JOIN s ON p.definition = s.definition AND p.t10 = s.t10 GROUP BY p.definition, p.t10
"""
ODDS = """
SELECT t.*, CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1e0 ELSE f.p_value END AS p_value,
  CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 'nan' WHEN b * c = 0 THEN 'inf' END AS odd, CASE WHEN b * c > 0 THEN a * d / (1e0 * b * c) END AS ratio,
  CASE WHEN a * b * c * d = 0 THEN 0.5e0 ELSE 0e0 END AS h
FROM tables2x2 t LEFT JOIN fisher f ON t.definition = f.definition AND t.t10 = f.t10
"""
DERIVED = {"tenths": TENTHS, "ways7": WAYS7, "halves": HALVES, "kinds3": KINDS3, "gaps": GAPS, "defs": DEFS, "groups": GROUPS, "frame": FRAME, "cases": CASES, "prevalence": PREVALENCE, "tables2x2": TABLES2X2, "fisher": FISHER, "odds": ODDS}
#: Those that read no fact.
CONSTANT = ("tenths", "ways7", "halves", "kinds3", "defs")

_AT = lambda x, agg="max": ", ".join(f"{agg}(CASE WHEN t10 = {t} THEN {x} END) AS t{t}" for t in range(1, 10))
_METRICS = ("precision", "recall", "f1", "specificity", "mcc", "roc_auc", "pr_auc", "density")
_U = "CASE WHEN k >= 2 THEN (CASE WHEN tp > 0 THEN 1e0 ELSE 0e0 END) * (1 - size / (1e0 * n)) END"
_PU = "CASE WHEN k >= 2 THEN precision * (1 - size / (1e0 * n)) END"


def _utility(u: str) -> str:
    return f"""
WITH u AS (SELECT strategy, t10, count({u}) AS c, avg({u}) AS mean, sum({u}) AS total FROM selection WHERE subset = 'solvable' GROUP BY strategy, t10),
f AS (SELECT t10, count(*) AS issues FROM frame WHERE subset = 'solvable' GROUP BY t10)
SELECT w.strategy, x.t10, cast(coalesce(u.c, 0) AS bigint) AS available, cast(coalesce(f.issues, 0) AS bigint) AS issues, round(100 * coalesce(u.c, 0) / (1e0 * f.issues), 6) AS availability_percent,
  CASE WHEN u.c > {SUPPORT} THEN round(100 * u.mean, 6) END AS conditional_percent, CASE WHEN u.c > {SUPPORT} THEN round(100 * u.total / f.issues, 6) END AS adjusted_percent
FROM ways7 w CROSS JOIN tenths x LEFT JOIN f ON f.t10 = x.t10 LEFT JOIN u ON u.strategy = w.strategy AND u.t10 = x.t10 WHERE w.strategy IN {STRATEGIES}"""


REPORTS: dict[str, str] = {
    # normalisers, filters, histograms
    "status_normalize": """
WITH raw AS (SELECT CASE WHEN status IN ('0', '1') AND t % 3 = 0 THEN concat(status, '.0') WHEN t % 3 = 1 THEN concat(' ', status, ' ') WHEN status = 'MISSING' AND t % 2 = 0 THEN NULL ELSE status END AS raw FROM candidate),
s AS (SELECT CASE WHEN raw IS NULL THEN 'NaN' WHEN trim(raw) IN ('1', '1.0') THEN '1' WHEN trim(raw) IN ('0', '0.0') THEN '0' ELSE trim(raw) END AS status FROM raw)
SELECT status, CASE WHEN status = '1' THEN 1 ELSE 0 END AS passed, status IN ('0', '1') AS usable, cast(count(*) AS bigint) AS cells FROM s GROUP BY status""",
    "syntax_histogram": """
WITH per AS (SELECT issue, cast(sum(syntax) AS int) AS valid_count FROM candidate GROUP BY issue), bins AS (SELECT DISTINCT t AS bin FROM candidate UNION SELECT 11 AS bin)
SELECT bins.bin, cast(count(per.issue) AS bigint) AS issues FROM bins LEFT JOIN per ON per.valid_count = bins.bin GROUP BY bins.bin""",
    "pass_histogram": """
WITH per AS (SELECT issue, cast(sum(CASE WHEN status = '1' THEN 1 ELSE 0 END) AS int) AS passes FROM candidate GROUP BY issue), bins AS (SELECT DISTINCT t AS bin FROM candidate UNION SELECT 11 AS bin)
SELECT bins.bin, cast(count(per.issue) AS bigint) AS issues FROM bins LEFT JOIN per ON per.passes = bins.bin GROUP BY bins.bin""",
    "solvable_partition": "SELECT coalesce(subset, 'dropped') AS subset, raw_pass, cast(count(*) AS bigint) AS issues, cast(sum(n) AS bigint) AS candidates, cast(sum(m) AS bigint) AS passing FROM issue GROUP BY subset, raw_pass",
    "validity_funnel": """
SELECT cast(count(*) AS bigint) AS cells, cast(sum(syntax) AS bigint) AS syntax_ok, cast(sum(CASE WHEN syntax = 1 AND status IN ('0', '1') THEN 1 ELSE 0 END) AS bigint) AS usable,
  cast(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS bigint) AS valid, cast(sum(CASE WHEN valid AND status = '1' THEN 1 ELSE 0 END) AS bigint) AS passing, cast(count(DISTINCT issue) AS bigint) AS issues, cast(count(DISTINCT CASE WHEN valid THEN issue END) AS bigint) AS clustered FROM candidate""",
    "availability_histogram": """
WITH there AS (SELECT issue, t FROM candidate WHERE status <> 'MISSING'), grid AS (SELECT DISTINCT issue, t FROM candidate),
gone AS (SELECT g.issue, cast(sum(CASE WHEN h.t IS NULL THEN 1 ELSE 0 END) AS int) AS missing FROM grid g LEFT JOIN there h ON g.issue = h.issue AND g.t = h.t GROUP BY g.issue), bins AS (SELECT DISTINCT t AS missing FROM candidate UNION SELECT 11 AS missing)
SELECT bins.missing, cast(count(gone.issue) AS bigint) AS issues FROM bins LEFT JOIN gone ON gone.missing = bins.missing GROUP BY bins.missing""",
    "missing_cells": "SELECT g.issue, g.t FROM candidate g WHERE NOT EXISTS (SELECT 1 FROM candidate h WHERE h.issue = g.issue AND h.t = g.t AND h.status <> 'MISSING')",
    "solvable_semi_join": "SELECT c.repo, cast(count(*) AS bigint) AS cells FROM candidate c WHERE c.issue IN (SELECT issue FROM issue WHERE subset = 'solvable') GROUP BY c.repo",
    "repo_totals": "SELECT repo, cast(count(DISTINCT issue) AS bigint) AS issues, cast(count(*) AS bigint) AS cells, cast(sum(CASE WHEN status = '1' THEN 1 ELSE 0 END) AS bigint) AS passing, cast(sum(CASE WHEN status = 'EMPTY_PATCH' THEN 1 ELSE 0 END) AS bigint) AS empty_patches, cast(sum(1 - syntax) AS bigint) AS broken FROM candidate GROUP BY repo",
    # similarity
    "bleu_pairs": "SELECT issue, i, j, score FROM pair",
    "similarity_subset": "SELECT issue, i, j, score FROM pair WHERE valid",
    # clustering
    "components_t09": "SELECT issue, t, cid FROM label WHERE t10 = 9",
    "components_all_t": "SELECT issue, t10, t, cid FROM label",
    "cluster_structure": "SELECT issue, t10, n, k, singles, multi, fulls, k - fulls AS not_fulls FROM frame",
    "fragmentation": "SELECT issue, t10, round(fragmentation, 6) AS fragmentation FROM frame",
    "density": "SELECT issue, t10, cid, size, round(density, 6) AS density FROM cluster",
    "size_pattern": "SELECT issue, t10, pattern FROM frame",
    "pattern_frequency": "SELECT t10, pattern, cast(count(*) AS bigint) AS issues FROM frame GROUP BY t10, pattern",
    "confusion": "SELECT issue, t10, cid, size, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(specificity, 6) AS specificity, round(mcc, 6) AS mcc FROM cluster",
    "roc_auc": "SELECT issue, t10, cid, round(roc_auc, 6) AS roc_auc FROM cluster",
    "avg_precision": "SELECT issue, t10, cid, round(pr_auc, 6) AS pr_auc FROM cluster",
    # summary and threshold reports
    "threshold_summary": "SELECT strategy, issue, subset, t10, n, m, k, coalesce(cid, -1) AS cid, size, tp, fp, fn, tn, " + ", ".join(f"round({x}, 6) AS {x}" for x in _METRICS) + " FROM selection",
    "threshold_averages": f"""
WITH f AS (SELECT subset, t10, count(*) AS issues FROM frame WHERE subset IS NOT NULL GROUP BY subset, t10)
SELECT h.subset, w.strategy, x.t10, cast(count(s.issue) AS bigint) AS available, cast(coalesce(max(f.issues), 0) AS bigint) AS issues, round(count(s.issue) / (1e0 * max(f.issues)), 6) AS availability, round(avg(1e0 * s.size), 6) AS avg_size, cast(sum(CASE WHEN s.tp = 0 THEN 1 ELSE 0 END) AS bigint) AS without_pass,
  {', '.join(f'round(avg(s.{x}), 6) AS avg_{x}' for x in _METRICS)}
FROM halves h CROSS JOIN ways7 w CROSS JOIN tenths x LEFT JOIN f ON f.subset = h.subset AND f.t10 = x.t10 LEFT JOIN selection s ON s.subset = h.subset AND s.strategy = w.strategy AND s.t10 = x.t10 GROUP BY h.subset, w.strategy, x.t10""",
    "matched_oracle": f"""
SELECT h.subset, w.strategy, x.t10, cast(count(s.issue) AS bigint) AS issues, round(avg(s.f1), 6) AS avg_f1, round(avg(o.f1), 6) AS oracle_f1, round(avg(o.f1) - avg(s.f1), 6) AS gap
FROM halves h CROSS JOIN ways7 w CROSS JOIN tenths x LEFT JOIN selection s ON s.subset = h.subset AND s.strategy = w.strategy AND s.t10 = x.t10
LEFT JOIN selection o ON o.strategy = 'oracle' AND o.issue = s.issue AND o.t10 = s.t10 WHERE w.strategy IN {STRATEGIES} GROUP BY h.subset, w.strategy, x.t10""",
    "strategy_availability": """
WITH f AS (SELECT t10, count(*) AS issues FROM frame GROUP BY t10)
SELECT w.strategy, x.t10, cast(count(s.issue) AS bigint) AS available, round(count(s.issue) / (1e0 * max(f.issues)), 6) AS rate
FROM ways7 w CROSS JOIN tenths x LEFT JOIN f ON f.t10 = x.t10 LEFT JOIN selection s ON s.strategy = w.strategy AND s.t10 = x.t10 GROUP BY w.strategy, x.t10""",
    "avg_size": "SELECT strategy, subset, " + _AT("round_size") + " FROM (SELECT strategy, subset, t10, round(avg(1e0 * size), 6) AS round_size FROM selection WHERE subset IS NOT NULL GROUP BY strategy, subset, t10) x GROUP BY strategy, subset",
    "avg_f1": "SELECT strategy, subset, " + _AT("round_f1") + " FROM (SELECT strategy, subset, t10, round(avg(f1), 6) AS round_f1 FROM selection WHERE subset IS NOT NULL GROUP BY strategy, subset, t10) x GROUP BY strategy, subset",
    "composition_rollup": """
SELECT subset, coalesce(cast(t10 AS varchar(9)), 'all_thresholds') AS threshold, cast(count(*) AS bigint) AS rows, cast(sum(n) AS bigint) AS candidates, cast(sum(k) AS bigint) AS clusters, cast(sum(singles) AS bigint) AS singletons, cast(sum(multi) AS bigint) AS non_singletons, cast(sum(fulls) AS bigint) AS fulls,
  round(sum(multi) / (1e0 * sum(k)), 6) AS non_singleton_rate, round(sum(singles) / (1e0 * sum(k)), 6) AS singleton_rate
FROM frame WHERE subset IS NOT NULL GROUP BY GROUPING SETS ((subset, t10), (subset))""",
    "best_configuration": f"""
WITH a AS (SELECT strategy, t10, round(avg(f1), 9) AS f1, round(avg(roc_auc), 9) AS roc_auc, CASE strategy {' '.join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(STRATEGIES))} END AS nth FROM selection WHERE subset = 'solvable' AND strategy IN {STRATEGIES} GROUP BY strategy, t10),
r AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, coalesce(roc_auc, -1e9) DESC, t10, nth) AS place FROM a)
SELECT strategy, t10, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM r WHERE place = 1""",
    "global_optimal": """
WITH a AS (SELECT strategy, t10, round(avg(f1), 9) AS f1, round(avg(precision), 9) AS p, round(avg(recall), 9) AS r FROM selection WHERE subset = 'solvable' GROUP BY strategy, t10),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY f1 DESC, p DESC, r DESC, t10) AS place FROM a)
SELECT strategy, t10, round(f1, 6) AS f1, round(p, 6) AS precision, round(r, 6) AS recall FROM r WHERE place = 1""",
    "oracle_threshold_per_issue": "SELECT issue, t10, round(f1, 6) AS f1 FROM (SELECT issue, t10, f1, row_number() OVER (PARTITION BY issue ORDER BY f1 DESC, precision DESC, recall DESC, t10) AS place FROM selection WHERE strategy = 'oracle') x WHERE place = 1",
    "threshold_range": "SELECT issue, cast(min(CASE WHEN k >= 2 THEN t10 END) AS double) AS min_t10, cast(max(CASE WHEN k < n THEN t10 END) AS double) AS max_t10 FROM frame GROUP BY issue",
    "range_avg_f1": """
WITH r AS (SELECT issue, min(CASE WHEN k >= 2 THEN t10 END) AS low, max(CASE WHEN k < n THEN t10 END) AS high FROM frame GROUP BY issue)
SELECT s.strategy, s.issue, cast(count(*) AS bigint) AS thresholds, round(avg(s.f1), 6) AS f1 FROM selection s JOIN r ON s.issue = r.issue AND s.t10 BETWEEN r.low AND r.high GROUP BY s.strategy, s.issue""",
    "range_avg_auc": """
WITH r AS (SELECT issue, min(CASE WHEN k >= 2 THEN t10 END) AS low, max(CASE WHEN k < n THEN t10 END) AS high FROM frame GROUP BY issue)
SELECT CASE WHEN s.strategy = 'oracle_roc_auc' THEN 'oracle' ELSE s.strategy END AS strategy, s.issue, round(avg(s.roc_auc), 6) AS roc_auc FROM selection s JOIN r ON s.issue = r.issue AND s.t10 BETWEEN r.low AND r.high WHERE s.strategy <> 'oracle' GROUP BY 1, s.issue""",
    "issue_f1_matrix": "SELECT issue, " + ", ".join(f"max(CASE WHEN strategy = '{s}' AND t10 = {t} THEN round(f1, 6) END) AS {s}_f1_t{t}" for s in ("oracle", *STRATEGIES) for t in range(1, 10)) + " FROM selection GROUP BY issue",
    "winner_ties": f"""
WITH s AS (SELECT issue, t10, k, strategy, f1, max(f1) OVER (PARTITION BY issue, t10) AS top, CASE strategy {' '.join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(STRATEGIES))} END AS nth FROM selection WHERE strategy IN {STRATEGIES}),
w AS (SELECT issue, t10, count(*) AS ways, replace(LISTAGG[strategy; nth], '|', '+') AS names FROM s WHERE k >= 2 AND f1 >= top - 1e-12 GROUP BY issue, t10)
SELECT issue, t10, CASE WHEN ways = 1 THEN names ELSE concat('tie:', names) END AS winner FROM w""",
    "issue_threshold_pivots": "SELECT issue, strategy, " + _AT("round(f1, 6)") + " FROM selection GROUP BY issue, strategy",
    "coclustering_close_far": """
WITH p AS (SELECT a.issue, a.t10, CASE WHEN b.t - a.t < 4 THEN 1 ELSE 0 END AS close, CASE WHEN a.cid = b.cid THEN 1e0 ELSE 0e0 END AS same FROM label a JOIN label b ON a.issue = b.issue AND a.t10 = b.t10 AND a.t < b.t),
r AS (SELECT issue, t10, avg(CASE WHEN close = 1 THEN same END) AS close_rate, avg(CASE WHEN close = 0 THEN same END) AS far_rate FROM p GROUP BY issue, t10)
SELECT i.subset, r.t10, cast(count(*) AS bigint) AS issues, round(avg(close_rate), 6) AS close_rate, round(avg(far_rate), 6) AS far_rate, round(avg(close_rate - far_rate), 6) AS delta FROM r JOIN issue i ON i.issue = r.issue WHERE i.subset IS NOT NULL GROUP BY i.subset, r.t10""",
    # utilities
    "utility": _utility(_U),
    "precision_utility": _utility(_PU),
    "utility_best": f"""
WITH u AS (SELECT strategy, t10, 100 * avg({_U}) AS u, count({_U}) AS c FROM selection WHERE strategy IN {STRATEGIES} AND subset = 'solvable' GROUP BY strategy, t10),
b AS (SELECT *, max(CASE WHEN c > {SUPPORT} THEN u END) OVER (PARTITION BY strategy) AS top FROM u)
SELECT strategy, min(t10) AS t10, round(max(top), 6) AS utility_percent FROM b WHERE c > {SUPPORT} AND abs(u - top) <= 1e-9 GROUP BY strategy""",
    "utility_by_issue": f"SELECT issue, strategy, {_AT('round(' + _U + ', 6)')} FROM selection WHERE strategy IN {STRATEGIES} GROUP BY issue, strategy",
    "strategy_precision": f"""
SELECT w.strategy, x.t10, cast(count(s.issue) AS bigint) AS available, cast(sum(CASE WHEN s.tp > 0 THEN 1 ELSE 0 END) AS bigint) AS with_correct, round(avg(s.precision), 6) AS mean_precision
FROM ways7 w CROSS JOIN tenths x LEFT JOIN selection s ON s.strategy = w.strategy AND s.t10 = x.t10 AND s.subset = 'solvable' WHERE w.strategy IN {STRATEGIES} GROUP BY w.strategy, x.t10""",
    # advantage over random choice
    "advantage_long": "SELECT issue, t10, cid, size, round(100e0 * tp / size, 6) AS hit, round(100e0 * m / n, 6) AS baseline, round(100e0 * tp / size - 100e0 * m / n, 6) AS advantage FROM cluster WHERE subset = 'solvable'",
    "advantage_compact": "SELECT issue, t10, LISTAGG[cast(size AS varchar(9)); size DESC, cid] AS sizes, LISTAGG[cast(tp AS varchar(9)); size DESC, cid] AS hits FROM cluster WHERE subset = 'solvable' GROUP BY issue, t10",
    "advantage_by_size": """
WITH a AS (SELECT issue, t10, size, avg(100e0 * tp / size - 100e0 * m / n) AS adv, count(*) AS c FROM cluster WHERE subset = 'solvable' GROUP BY issue, t10, size),
g AS (SELECT s.t + 1 AS size, f.t10 FROM (SELECT DISTINCT t FROM candidate) s CROSS JOIN (SELECT DISTINCT t10 FROM frame) f)
SELECT g.size, g.t10, cast(coalesce(sum(a.c), 0) AS bigint) AS clusters, cast(count(a.issue) AS bigint) AS issues, round(avg(a.adv), 6) AS mean_advantage FROM g LEFT JOIN a ON a.size = g.size AND a.t10 = g.t10 GROUP BY g.size, g.t10""",
    "agreement_vs_union": """
WITH a AS (SELECT issue, t10, max(n) AS n, max(m) AS m, avg(CASE WHEN size >= 2 THEN 100e0 * tp / size - 100e0 * m / n END) AS agree, sum(CASE WHEN size = 1 THEN tp END) AS st, sum(CASE WHEN size = 1 THEN 1 END) AS sc FROM cluster WHERE subset = 'solvable' GROUP BY issue, t10),
d AS (SELECT issue, t10, agree, 100e0 * st / sc - 100e0 * m / n AS uni FROM a WHERE agree IS NOT NULL AND sc IS NOT NULL)
SELECT issue, cast(count(*) AS bigint) AS thresholds, round(avg(agree), 6) AS agreement, round(avg(uni), 6) AS singleton_union, round(avg(agree - uni), 6) AS delta, round(avg(agree - uni), 9) > 1e-9 AS agreement_better FROM d GROUP BY issue""",
    "win_percentage": """
WITH a AS (SELECT issue, t10, max(n) AS n, max(m) AS m, avg(CASE WHEN size >= 2 THEN 100e0 * tp / size - 100e0 * m / n END) AS agree, sum(CASE WHEN size = 1 THEN tp END) AS st, sum(CASE WHEN size = 1 THEN 1 END) AS sc FROM cluster WHERE subset = 'solvable' GROUP BY issue, t10),
w AS (SELECT m, t10, avg(CASE WHEN agree - (100e0 * st / sc - 100e0 * m / n) > 1e-9 THEN 100e0 ELSE 0e0 END) AS win FROM a WHERE agree IS NOT NULL AND sc IS NOT NULL GROUP BY m, t10)
SELECT m AS passing, """ + _AT("round(win, 6)") + " FROM w GROUP BY m",
    "subgroup_summary": """
WITH a AS (SELECT issue, t10, max(n) AS n, max(m) AS m, avg(CASE WHEN size >= 2 THEN 100e0 * tp / size - 100e0 * m / n END) AS agree, sum(CASE WHEN size = 1 THEN tp END) AS st, sum(CASE WHEN size = 1 THEN 1 END) AS sc FROM cluster WHERE subset = 'solvable' GROUP BY issue, t10),
d AS (SELECT issue, max(m) AS m, avg(agree) AS agree, avg(100e0 * st / sc - 100e0 * m / n) AS uni FROM a WHERE agree IS NOT NULL AND sc IS NOT NULL GROUP BY issue)
SELECT m AS passing, cast(count(*) AS bigint) AS issues, round(avg(agree), 6) AS agreement, round(avg(uni), 6) AS singleton_union, round(avg(agree - uni), 6) AS delta, cast(sum(CASE WHEN agree - uni > 1e-9 THEN 1 ELSE 0 END) AS bigint) AS wins FROM d GROUP BY m""",
    # majority agreement and solvability
    "rq1_prevalence": "SELECT definition, subset, t10, valid_issues, with_majority, round(with_majority / (1e0 * valid_issues), 6) AS prevalence FROM prevalence",
    "rq1_difference": "SELECT definition, t10, round(a / (1e0 * (a + b)), 6) AS solvable, round(c / (1e0 * (c + d)), 6) AS nonsolvable, round(a / (1e0 * (a + b)) - c / (1e0 * (c + d)), 6) AS delta FROM tables2x2 WHERE a + b > 0 AND c + d > 0",
    "rq1_fisher": "SELECT definition, t10, a, b, c, d, coalesce(odd, cast(round(ratio, 6) AS varchar(40))) IN ('nan', 'inf') AS extreme, round(ratio, 6) AS odds_ratio, round(p_value, 6) AS p_value FROM odds",
    "rq1_or_ci": """
WITH w AS (SELECT *, ln((a + h) * (d + h) / ((b + h) * (c + h))) AS lo, sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h)) AS se FROM odds WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0)
SELECT definition, t10, round(exp(lo), 6) AS corrected_ratio, round(exp(lo - 1.959963984540054e0 * se), 6) AS low, round(exp(lo + 1.959963984540054e0 * se), 6) AS high FROM w""",
    "rq1_tstar": """
WITH o AS (SELECT definition, t10, p_value, CASE WHEN odd = 'inf' THEN 1e300 WHEN odd = 'nan' THEN NULL ELSE round(ratio, 9) END AS r FROM odds),
s AS (SELECT *, CASE WHEN p_value < 5e-2 AND r IS NOT NULL THEN 0 WHEN t10 > 5 AND r IS NOT NULL THEN 1 WHEN t10 > 5 THEN 2 ELSE 3 END AS tier FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY definition ORDER BY tier, CASE WHEN tier <= 1 THEN r END DESC, t10 DESC) AS place FROM s)
SELECT definition, t10, tier FROM p WHERE place = 1""",
    # coverage, false positives, gains
    "rq2_coverage": "SELECT definition, grp, " + _AT("v") + " FROM (SELECT definition, grp, t10, round(avg(tp / (1e0 * m)), 6) AS v FROM groups WHERE subset = 'solvable' GROUP BY definition, grp, t10) x GROUP BY definition, grp",
    "rq2_counts": """
SELECT d.definition, k.grp, x.t10, cast(count(g.issue) AS bigint) AS available, cast(sum(CASE WHEN g.tp > 0 THEN 1 ELSE 0 END) AS bigint) AS with_correct
FROM defs d CROSS JOIN kinds3 k CROSS JOIN tenths x LEFT JOIN groups g ON g.definition = d.definition AND g.grp = k.grp AND g.t10 = x.t10 AND g.subset = 'solvable' GROUP BY d.definition, k.grp, x.t10""",
    "rq2_fp": "SELECT definition, grp, " + _AT("v") + " FROM (SELECT definition, grp, t10, round(avg(1e0 * (size - tp)), 6) AS v FROM groups WHERE subset = 'solvable' AND tp > 0 GROUP BY definition, grp, t10) x GROUP BY definition, grp",
    "rq2_main": "SELECT definition, " + ", ".join(f"cast(sum(CASE WHEN grp = '{g}' THEN 1 ELSE 0 END) AS bigint) AS {g}_n, cast(sum(CASE WHEN grp = '{g}' AND tp > 0 THEN 1 ELSE 0 END) AS bigint) AS {g}_correct_n, round(avg(CASE WHEN grp = '{g}' THEN tp / (1e0 * m) END), 6) AS {g}_coverage, round(avg(CASE WHEN grp = '{g}' AND tp > 0 THEN 1e0 * (size - tp) END), 6) AS {g}_fp" for g in ("majority", "minority", "disagreement")) + " FROM groups WHERE subset = 'solvable' AND t10 = 9 GROUP BY definition",
    "rq3_gain": "SELECT definition, issue, grp, " + _AT("round(gain, 6)") + " FROM cases GROUP BY definition, issue, grp",
    "rq3_delta": """
WITH w AS (SELECT definition, issue, t10, max(m) AS m, max(CASE WHEN grp = 'majority' THEN gain END) AS maj, max(CASE WHEN grp = 'minority' THEN gain END) AS mino, max(CASE WHEN grp = 'disagreement' THEN gain END) AS dis FROM cases GROUP BY definition, issue, t10)
SELECT definition, m AS passing, t10, round(100 * avg(CASE WHEN maj - dis > 1e-9 THEN 1e0 WHEN maj - dis IS NOT NULL THEN 0e0 END), 6) AS majority_wins, round(100 * avg(CASE WHEN mino - dis > 1e-9 THEN 1e0 WHEN mino - dis IS NOT NULL THEN 0e0 END), 6) AS minority_wins,
  round(100 * avg(CASE WHEN maj - dis > 1e-9 OR mino - dis > 1e-9 THEN 1e0 WHEN maj - dis IS NOT NULL OR mino - dis IS NOT NULL THEN 0e0 END), 6) AS any_wins FROM w GROUP BY definition, m, t10""",
    "rq3_positive_gain": "SELECT definition, m AS passing, grp, t10, cast(count(*) AS bigint) AS cases, round(100 * avg(CASE WHEN gain > 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS positive_percent FROM cases GROUP BY definition, m, grp, t10",
    "rq3_case_summary": "SELECT definition, m AS correct_fixes, " + ", ".join(f"cast(sum(CASE WHEN grp = '{g}' THEN 1 ELSE 0 END) AS bigint) AS {g}_available, cast(sum(CASE WHEN grp = '{g}' THEN correct ELSE 0 END) AS bigint) AS {g}_with_correct, round(100 * avg(CASE WHEN grp = '{g}' THEN 1e0 * correct END), 6) AS {g}_ratio" for g in ("majority", "minority", "disagreement")) + " FROM cases GROUP BY definition, m",
    "rq3_main": "SELECT definition, grp, " + ", ".join(f"round(avg(CASE WHEN m = {k} THEN CASE WHEN gain > 1e-9 THEN 1e0 ELSE 0e0 END END), 6) AS m{k}" for k in range(1, 12)) + " FROM cases WHERE t10 = 9 GROUP BY definition, grp",
    "latex_f1": """
WITH c AS (SELECT w.strategy, x.t10, h.subset, cast(round(1000 * avg(s.f1)) AS bigint) AS v FROM halves h CROSS JOIN ways7 w CROSS JOIN tenths x LEFT JOIN selection s ON s.subset = h.subset AND s.strategy = w.strategy AND s.t10 = x.t10 GROUP BY w.strategy, x.t10, h.subset),
z AS (SELECT strategy, t10, subset, CASE WHEN v IS NULL THEN '--' ELSE concat(cast((v - v % 1000) / 1000 AS int), '.', lpad(cast(v % 1000 AS varchar(9)), 3, '0')) END AS cell FROM c)
SELECT strategy, concat(strategy, ' & ', replace(LISTAGG[cell; t10, subset], '|', ' & ')) AS line FROM z GROUP BY strategy""",
    "issue_tables_by_threshold": "SELECT f.t10, f.issue, f.subset, f.n, f.m, f.n - f.m AS fails, f.k, f.multi, f.singles, f.pattern, round(f.fragmentation, 6) AS fragmentation, " + ", ".join(f"max(CASE WHEN s.strategy = '{w}' THEN round(s.f1, 6) END) AS {w}_f1, cast(max(CASE WHEN s.strategy = '{w}' THEN 1 ELSE 0 END) AS int) AS {w}_available" for w in ("oracle", *STRATEGIES)) + " FROM frame f LEFT JOIN selection s ON s.issue = f.issue AND s.t10 = f.t10 GROUP BY f.t10, f.issue, f.subset, f.n, f.m, f.k, f.multi, f.singles, f.pattern, f.fragmentation",
    "configured_avg_f1": "SELECT 'fixture' AS dataset, 'variants' AS model, 'bleu' AS metric, h.subset, w.strategy, x.t10, round(avg(s.f1), 6) AS f1 FROM halves h CROSS JOIN ways7 w CROSS JOIN tenths x LEFT JOIN selection s ON s.subset = h.subset AND s.strategy = w.strategy AND s.t10 = x.t10 GROUP BY h.subset, w.strategy, x.t10",
    "subset_partition": """
WITH a AS (SELECT issue, n, subset, CASE WHEN raw_pass AND m > 0 THEN 1 ELSE 0 END AS s, CASE WHEN n > 0 AND NOT raw_pass THEN 1 ELSE 0 END AS o FROM issue)
SELECT cast(count(*) AS bigint) AS issues, cast(sum(s) AS bigint) AS solvable, cast(sum(o) AS bigint) AS nonsolvable, cast(sum(CASE WHEN s + o > 1 THEN 1 ELSE 0 END) AS bigint) AS in_both, cast(sum(CASE WHEN s + o = 0 THEN 1 ELSE 0 END) AS bigint) AS dropped,
  cast(sum(CASE WHEN s + o = 0 AND subset IS NOT NULL OR s + o = 1 AND subset IS NULL THEN 1 ELSE 0 END) AS bigint) AS misplaced FROM a""",
    "subgroup_by_threshold": """
WITH s AS (SELECT m, count(DISTINCT issue) AS total FROM frame WHERE subset = 'solvable' GROUP BY m)
SELECT s.m AS passing, x.t10, cast(max(s.total) AS bigint) AS total_issues, cast(count(g.issue) AS bigint) AS issues, round(avg(g.agree), 6) AS agreement, round(avg(g.uni), 6) AS singleton_union, round(avg(g.agree - g.uni), 6) AS delta,
  round(avg(CASE WHEN g.agree - g.uni > 1e-12 THEN 100e0 WHEN g.issue IS NOT NULL THEN 0e0 END), 6) AS better_percent
FROM s CROSS JOIN tenths x LEFT JOIN gaps g ON g.m = s.m AND g.t10 = x.t10 GROUP BY s.m, x.t10""",
    "comparison_gaps": "SELECT issue, t10, m AS passing, round(agree, 6) + 0e0 AS agreement, round(uni, 6) + 0e0 AS singleton_union FROM gaps",
    "invariants": """
SELECT cast(sum(CASE WHEN s.size < 1 OR s.size > s.n OR s.tp < 0 OR s.tp > s.size THEN 1 ELSE 0 END) AS bigint) AS bad_sizes, cast(sum(CASE WHEN s.strategy IN ('largest', 'smallest', 'singleton_furthest') AND s.f1 > o.f1 + 1e-9 THEN 1 ELSE 0 END) AS bigint) AS above_oracle, cast(count(DISTINCT o.issue) AS bigint) AS issues
FROM selection s JOIN selection o ON o.strategy = 'oracle' AND o.issue = s.issue AND o.t10 = s.t10""",
} | {f"select_{s}": f"SELECT issue, t10, coalesce(cid, -1) AS cid, size, tp, round(f1, 6) AS f1 FROM selection WHERE strategy = '{s}'" for s in ("largest", "smallest", "densest", "singleton_furthest", "singleton_union", "oracle", "oracle_roc_auc")}


def _log_factorial(n: str) -> str:
    """By Stirling's series, to 1e-11, above what factorial() takes."""
    x = f"cast({n} AS double)"
    return f"(CASE WHEN {n} <= 20 THEN ln(factorial(cast({n} AS int))) ELSE {x} * ln({x}) - {x} + 0.5D * ln(2 * pi() * {x}) + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) END)"


_RELATION = re.compile(r"\b(?:FROM|JOIN)\s+(\w+|\(\))(?:\s+(?:AS\s+)?(?!(?:ON|WHERE|JOIN|LEFT|CROSS|GROUP|ORDER|HAVING|UNION)\b)(\w+))?")


def _merged(sql: str) -> str:
    """Each SELECT that joins told to merge what it joins, but for constant tables: Spark would judge a table by the size
    of its files, which says little about its rows, and broadcast it."""
    out, done = [], 0
    for m in re.finditer(r"\bSELECT\b", sql):
        depth, flat = 0, []
        for c in sql[m.end() :]:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
            if depth == 0 or depth == 1 and c == "(":
                flat.append(c)
        own = re.split(r"\bUNION\b", "".join(flat))[0]
        names = [alias or name for name, alias in _RELATION.findall(own) if name not in CONSTANT and (alias or name) != "()"] if " JOIN " in own else []
        out.append(sql[done : m.end()] + (f" /*+ MERGE({', '.join(names)}) */" if names else ""))
        done = m.end()
    return "".join(out) + sql[done:]


def spell(sql: str, spark: bool) -> str:
    """The SQL in one of the dialects."""
    sql = _merged(sql) if spark else sql
    sql = re.sub(r"LF\[([^\]]*)\]", lambda m: _log_factorial(f"({m[1]})") if spark else f"lgamma({m[1]} + 1e0)", sql)
    sql = re.sub(r"SERIES\[([^;\]]*); ([^;\]]*); ([^\]]*)\]", r"explode(sequence(\1, \2, \3))" if spark else r"unnest(generate_series(\1, \2, \3))", sql)
    return re.sub(r"LISTAGG\[([^;\]]*); ([^\]]*)\]", r"listagg(\1, '|') WITHIN GROUP (ORDER BY \2)" if spark else r"string_agg(\1, '|' ORDER BY \2)", sql)
