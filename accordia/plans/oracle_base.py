"""The fact tables, and what reports build on, once more in DuckDB's SQL by other means: n-gram joins for BLEU, recursion
for components, counted pairs for ROC-AUC, metrics from margins, selections by what nothing beats."""

from __future__ import annotations

import re

from . import facts

CANDIDATE = r"""
WITH base AS (SELECT doc_id AS issue, source AS repo, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:24] AS tok FROM documents),
varied AS (SELECT *, unnest(generate_series(0, 10)) AS t FROM base),
picked AS (SELECT issue, repo, lang, tok, t, CASE issue % 5
    WHEN 0 THEN CASE WHEN t <= 6 THEN 0 WHEN t <= 8 THEN 1 ELSE t - 6 END
    WHEN 1 THEN CASE WHEN t IN (0, 1, 9) THEN 0 WHEN t IN (2, 3, 10) THEN 1 WHEN t IN (4, 5) THEN 2 ELSE t - 2 END
    WHEN 2 THEN 0 WHEN 3 THEN t ELSE CASE WHEN t <= 5 THEN 0 ELSE 1 END END AS v FROM varied),
made AS (SELECT issue, repo, lang, CAST(t AS INTEGER) AS t, CAST(v AS INTEGER) AS v, array_to_string(tok, ' ') AS removed,
  array_to_string(list_transform(tok, lambda x, i: CASE WHEN ((i - 1) * 13 + issue * 5 + v * 11) % 24 < v * 2 THEN concat('x', v, '_', i - 1) ELSE x END), ' ') AS added,
  CASE WHEN (issue * 3 + t) % 29 = 0 THEN 'MISSING' WHEN (issue * 3 + t) % 31 = 0 THEN 'EMPTY_PATCH' WHEN v = issue % 4 AND issue % 3 <> 0 THEN '1' ELSE '0' END AS status,
  CASE WHEN (issue + t) % 13 = 0 THEN 0 ELSE 1 END AS syntax FROM picked)
SELECT *, syntax = 1 AND status IN ('0', '1') AND added <> '' AS valid FROM made
"""
LENGTHS = r"SELECT issue, t, valid, list_filter(string_split_regex(added, '\s+'), lambda x: x <> '') AS tok FROM candidate"
GRAM = """
SELECT issue, t, n, array_to_string(tok[p:p + n - 1], ' ') AS g, count(*) AS c
FROM (SELECT issue, t, tok, n, unnest(generate_series(1, len(tok) - n + 1)) AS p FROM lengths, (SELECT unnest(generate_series(1, 4)) AS n)) GROUP BY ALL
"""


def _directed(c: str, r: str) -> str:
    logs = " + ".join(f"ln(CASE WHEN m{n} = 0 THEN 0.1e0 ELSE m{n} END / (1e0 * greatest(1, {c} - {n - 1})))" for n in range(1, 5))
    return f"CASE WHEN m1 = 0 THEN 0e0 ELSE CASE WHEN {c} > {r} THEN 1e0 ELSE exp(1e0 - {r} / (1e0 * {c})) END * exp(0.25e0 * ({logs})) END"


PAIR = f"""
WITH hit AS (SELECT a.issue, a.t AS i, b.t AS j, {', '.join(f'sum(CASE WHEN a.n = {n} THEN least(a.c, b.c) ELSE 0 END) AS m{n}' for n in range(1, 5))}
  FROM gram a JOIN gram b ON a.issue = b.issue AND a.n = b.n AND a.g = b.g AND a.t < b.t GROUP BY 1, 2, 3),
whole AS (SELECT a.issue, a.t AS i, b.t AS j, a.valid AND b.valid AS valid, len(a.tok) AS la, len(b.tok) AS lb, {', '.join(f'coalesce(h.m{n}, 0) AS m{n}' for n in range(1, 5))}
  FROM lengths a JOIN lengths b ON a.issue = b.issue AND a.t < b.t LEFT JOIN hit h ON h.issue = a.issue AND h.i = a.t AND h.j = b.t)
SELECT issue, i, j, valid, round(CASE WHEN la = 0 AND lb = 0 THEN 1e0 WHEN la = 0 OR lb = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, ({_directed('la', 'lb')} + {_directed('lb', 'la')}) / 2e0)) END, 6) AS score FROM whole
"""
ISSUE = """
WITH s AS (SELECT issue, CAST(count(*) FILTER (valid) AS INTEGER) AS n, CAST(count(*) FILTER (valid AND status = '1') AS INTEGER) AS m, bool_or(status = '1') AS raw_pass FROM candidate GROUP BY issue)
SELECT issue, n, m, raw_pass, CASE WHEN n = 0 THEN NULL WHEN raw_pass AND m > 0 THEN 'solvable' WHEN NOT raw_pass THEN 'nonsolvable' END AS subset FROM s
"""
EDGE = """
SELECT issue, t10, i, j FROM sim, (SELECT unnest(generate_series(1, 9)) AS t10) WHERE i <> j AND score >= t10 / 10e0
"""
WALK = """
SELECT issue, t10, t AS i, t AS j FROM candidate, (SELECT unnest(generate_series(1, 9)) AS t10) WHERE valid
UNION SELECT w.issue, w.t10, w.i, e.j FROM walk w JOIN edge e ON w.issue = e.issue AND w.t10 = e.t10 AND w.j = e.i
"""
LABEL = """
WITH r AS (SELECT issue, t10, i, min(j) AS rep FROM walk GROUP BY issue, t10, i)
SELECT issue, CAST(t10 AS INTEGER) AS t10, i AS t, CAST(dense_rank() OVER (PARTITION BY issue, t10 ORDER BY rep) - 1 AS INTEGER) AS cid FROM r
"""
REACH = """
SELECT l.issue, l.t10, l.cid, c.t AS i, CASE c.status WHEN '1' THEN 1 ELSE 0 END AS pass, round(sum(s.score) / count(*), 9) AS reach
FROM candidate c JOIN sim s ON s.issue = c.issue AND s.i = c.t JOIN label l ON l.issue = s.issue AND l.t = s.j WHERE c.valid GROUP BY ALL
"""
#: ROC-AUC by counting pairs of a passing and a failing candidate; average precision as the mean, over the passing ones, of the precision at their score.
CURVES = """
WITH size AS (SELECT issue, t10, cid, sum(pass) AS m, count(*) AS n FROM reach GROUP BY ALL),
won AS (SELECT p.issue, p.t10, p.cid, sum(CASE WHEN p.reach > q.reach THEN 1e0 WHEN p.reach = q.reach THEN 0.5e0 ELSE 0e0 END) AS w FROM reach p JOIN reach q USING (issue, t10, cid) WHERE p.pass = 1 AND q.pass = 0 GROUP BY ALL),
prec AS (SELECT p.issue, p.t10, p.cid, p.i, sum(q.pass) / (1e0 * count(*)) AS precision FROM reach p JOIN reach q USING (issue, t10, cid) WHERE p.pass = 1 AND q.reach >= p.reach GROUP BY ALL),
ap AS (SELECT issue, t10, cid, sum(precision) AS s FROM prec GROUP BY ALL)
SELECT issue, t10, cid, CASE WHEN m IN (0, n) THEN 0e0 ELSE round(w / (m * (n - m)), 9) END AS roc_auc, CASE WHEN m IN (0, n) THEN 0e0 ELSE round(s / m, 9) END AS pr_auc
FROM size LEFT JOIN won USING (issue, t10, cid) LEFT JOIN ap USING (issue, t10, cid)
"""
#: Over ordered pairs of members.
DENSE = """
SELECT a.issue, a.t10, a.cid, round(avg(s.score), 9) AS density FROM label a JOIN label b USING (issue, t10, cid) JOIN sim s ON s.issue = a.issue AND s.i = a.t AND s.j = b.t WHERE a.t <> b.t GROUP BY ALL
"""
#: Metrics from the margins: selected and passing candidates, and those that are both.
CLUSTER = """
WITH own AS (SELECT l.issue, l.t10, l.cid, count(*)::INTEGER AS size, (count(*) FILTER (c.status = '1'))::INTEGER AS tp FROM label l JOIN candidate c USING (issue, t) GROUP BY ALL),
per AS (SELECT issue, t10, count(*)::INTEGER AS k, (count(*) FILTER (size > 1))::INTEGER AS multi FROM own GROUP BY ALL),
q AS (SELECT * FROM own JOIN per USING (issue, t10) JOIN issue USING (issue))
SELECT issue, subset, n, m, t10, cid, size, tp, size - tp AS fp, m - tp AS fn, n - m - (size - tp) AS tn, round(tp / (1e0 * size), 9) AS precision, CASE m WHEN 0 THEN 0e0 ELSE round(tp / (1e0 * m), 9) END AS recall, round(2 * tp / (1e0 * (size + m)), 9) AS f1,
  CASE n - m WHEN 0 THEN 0e0 ELSE round(1 - (size - tp) / (1e0 * (n - m)), 9) END AS specificity, CASE WHEN size = n OR m IN (0, n) THEN 0e0 ELSE round((n * tp - size * m) / sqrt(1e0 * size * m * (n - size) * (n - m)), 9) END AS mcc,
  coalesce(density, 1e0) AS density, coalesce(roc_auc, 0e0) AS roc_auc, coalesce(pr_auc, 0e0) AS pr_auc, k, multi
FROM q LEFT JOIN dense USING (issue, t10, cid) LEFT JOIN curves USING (issue, t10, cid)
"""


def _best(source: str, order: str, tie: str = "d.cid < c.cid", also: str = "") -> str:
    """Rows of source that none of their issue and threshold beats: order is a tuple of columns, larger is better."""
    d, c = (", ".join(f"{sign}{x}.{name}" for sign, name in ((("-", o[1:]) if o[0] == "-" else ("", o)) for o in order.split())) for x in "dc")
    return f"SELECT c.* FROM {source} c WHERE NOT EXISTS (SELECT 1 FROM {source} d WHERE d.issue = c.issue AND d.t10 = c.t10{also} AND (({d}) > ({c}) OR ({d}) = ({c}) AND {tie}))"


_TEXT = "CAST(d.cid AS VARCHAR) < CAST(c.cid AS VARCHAR)"
BIG, SINGLE = "SELECT * FROM cluster WHERE size > 1", "SELECT c.*, l.t FROM cluster c JOIN label l USING (issue, t10, cid) WHERE size = 1"
TOP = _best("big", "size density")
LOW = _best("beside", "-size density")
BESIDE = "SELECT b.* FROM big b JOIN top t ON t.issue = b.issue AND t.t10 = b.t10 AND t.cid <> b.cid"
#: Mean distance of singletons to the others.
LONER = "SELECT s.*, coalesce(d.far, 0e0) AS far FROM single s LEFT JOIN (SELECT issue, i, round(sum(1 - score) / count(*), 9) AS far FROM sim WHERE i <> j GROUP BY ALL) d ON d.issue = s.issue AND d.i = s.t"
#: Selections by what no other cluster beats, without ranks.
SELECTION = f"""
WITH pooled AS (SELECT issue, subset, n, m, k, multi, t10, sum(size)::INTEGER AS size, sum(tp)::INTEGER AS tp FROM single GROUP BY ALL HAVING count(*) > 1),
chosen AS (SELECT 'largest' AS strategy, {facts.FIELDS} FROM top UNION ALL SELECT 'smallest', {facts.FIELDS} FROM low UNION ALL SELECT 'densest', {facts.FIELDS} FROM ({_best('cluster', 'density')})
  UNION ALL SELECT 'oracle', {facts.FIELDS} FROM ({_best('cluster', 'f1 precision recall density size', _TEXT)}) UNION ALL SELECT 'oracle_roc_auc', {facts.FIELDS} FROM ({_best('cluster', 'roc_auc f1 precision recall', _TEXT)})
  UNION ALL SELECT 'singleton_furthest', {facts.FIELDS} FROM ({_best('loner', 'far', 'd.t < c.t')}))
SELECT * FROM chosen
UNION ALL SELECT 'singleton_union', issue, subset, n, m, k, multi, t10, NULL, size, tp, size - tp, m - tp, n - m - (size - tp), round(tp / (1e0 * size), 9), CASE m WHEN 0 THEN 0e0 ELSE round(tp / (1e0 * m), 9) END, round(2 * tp / (1e0 * (size + m)), 9),
  CASE n - m WHEN 0 THEN 0e0 ELSE round(1 - (size - tp) / (1e0 * (n - m)), 9) END, CASE WHEN size = n OR m IN (0, n) THEN 0e0 ELSE round((n * tp - size * m) / sqrt(1e0 * size * m * (n - size) * (n - m)), 9) END, NULL, NULL, NULL FROM pooled
"""
TABLES = {
    "candidate": CANDIDATE, "lengths": LENGTHS, "gram": GRAM, "pair": PAIR, "issue": ISSUE, "sim": facts.SIM, "edge": EDGE, "walk": WALK, "label": LABEL,
    "reach": REACH, "curves": CURVES, "dense": DENSE, "cluster": CLUSTER, "big": BIG, "single": SINGLE, "top": TOP, "beside": BESIDE, "low": LOW, "loner": LONER, "selection": SELECTION,
}
#: What reports build on, once more from the clusters: a majority is a cluster of more than half, or the largest one, that isn't all.
DERIVED = {
    "groups": """
SELECT '1-Majority' AS definition, issue, subset, n, m, k, t10, 'majority' AS grp, size, tp FROM big WHERE 2 * size > n AND size < n
UNION ALL SELECT '2-Largest', issue, subset, n, m, k, t10, 'majority', size, tp FROM top WHERE size < n
UNION ALL SELECT unnest(['1-Majority', '2-Largest']), issue, subset, n, m, k, t10, 'minority', size, tp FROM low
UNION ALL SELECT '1-Majority', issue, subset, n, m, k, t10, 'minority', size, tp FROM big b WHERE 2 * size <= n AND NOT EXISTS (SELECT 1 FROM beside o WHERE o.issue = b.issue AND o.t10 = b.t10)
UNION ALL SELECT unnest(['1-Majority', '2-Largest']), issue, subset, n, m, k, t10, 'disagreement', sum(size)::INTEGER, sum(tp)::INTEGER FROM single GROUP BY issue, subset, n, m, k, t10
""",
    "frame": """
SELECT issue, any_value(subset) AS subset, max(n) AS n, max(m) AS m, t10, count(*)::INTEGER AS k, (count(*) FILTER (size > 1))::INTEGER AS multi, (count(*) FILTER (size = 1))::INTEGER AS singles, (count(*) FILTER (size = n))::INTEGER AS fulls,
  CASE max(n) WHEN 1 THEN 0e0 ELSE round(1 - sum(size * (size - 1)) / (1e0 * max(n) * (max(n) - 1)), 9) END AS fragmentation, array_to_string(list_reverse_sort(list(size)), '|') AS pattern FROM cluster GROUP BY issue, t10
""",
    "prevalence": """
WITH able AS (SELECT issue, any_value(subset) AS subset, t10 FROM cluster WHERE subset IS NOT NULL GROUP BY issue, t10 HAVING count(*) BETWEEN 2 AND max(n) - 1), agreed AS (SELECT DISTINCT definition, issue, t10 FROM groups WHERE grp = 'majority'),
counts AS (SELECT definition, subset, t10, count(*) AS c FROM able JOIN agreed USING (issue, t10) GROUP BY ALL)
SELECT definition, subset, t10, valid_issues, coalesce(c, 0) AS with_majority FROM (SELECT subset, t10, count(*) AS valid_issues FROM able GROUP BY ALL) CROSS JOIN (SELECT unnest(['1-Majority', '2-Largest']) AS definition) LEFT JOIN counts USING (definition, subset, t10)
""",
    "tables2x2": """
SELECT definition, t10, coalesce(sum(with_majority) FILTER (subset = 'solvable'), 0)::BIGINT AS a, coalesce(sum(valid_issues - with_majority) FILTER (subset = 'solvable'), 0)::BIGINT AS b,
  coalesce(sum(with_majority) FILTER (subset = 'nonsolvable'), 0)::BIGINT AS c, coalesce(sum(valid_issues - with_majority) FILTER (subset = 'nonsolvable'), 0)::BIGINT AS d FROM prevalence GROUP BY ALL
""",
    "fisher": """
WITH w AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1 FROM tables2x2), x AS (SELECT *, unnest(generate_series(greatest(0, c1 - r2), least(r1, c1))) AS x FROM w),
p AS (SELECT definition, t10, a, x, lgamma(r1 + 1e0) - lgamma(x + 1e0) - lgamma(r1 - x + 1e0) + lgamma(r2 + 1e0) - lgamma(c1 - x + 1e0) - lgamma(r2 - c1 + x + 1e0) AS w FROM x),
r AS (SELECT *, w - max(w) OVER (PARTITION BY definition, t10) AS v, max(CASE WHEN x = a THEN w END) OVER (PARTITION BY definition, t10) - max(w) OVER (PARTITION BY definition, t10) AS seen FROM p)
SELECT definition, t10, sum(exp(v)) FILTER (v <= seen + 1e-7) / sum(exp(v)) AS p_value FROM r GROUP BY definition, t10
""",
    "cases": """
SELECT definition, issue, t10, n, m, grp, (tp > 0)::INTEGER AS correct, round(100e0 * (tp * n - m * size) / (size * n), 9) AS gain FROM groups WHERE subset = 'solvable' AND k BETWEEN 2 AND n - 1
""",
}


def with_tables(sql: str, more: dict[str, str] | None = None) -> str:
    """The report's SQL behind the tables it needs."""
    known = TABLES | (more or {})
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in known:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(known[name])
    parts = [f"{name} AS {'' if name == 'walk' else 'MATERIALIZED '}({known[name].strip()})" for name in known if name in need]
    body = sql.strip()
    if not parts:
        return body
    if body.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body.removeprefix("WITH ")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
