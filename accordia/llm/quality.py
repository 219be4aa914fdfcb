"""Operator 1: quality rules whose cutoffs come with a bound on how many good documents they reject together.

Labelled documents are dealt by a hash of their id into a tuning part and a holdout. On the tuning part each stratum
(language) gets, of each rule (a statistic and a side), the cutoff that rejects most bad documents, less `good_weight`
times the good ones; its rules are then ordered by that gain. On the holdout the first rule, the first two together, and
so on are tested in this order: a set is certified while the exact binomial test rejects "at least `risk` of the
stratum's good documents would fall to one of these rules" at the stratum's share of `error`. Bonferroni over the
strata, a fixed sequence within one: with probability 1 - error, no stratum loses more than `risk` of its good documents
to all of its rules together. The largest certified set is used.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Cutoffs of each rule from lenient to strict; "+": larger values are worse, "-": smaller ones are.
RULES: dict[tuple[str, str], tuple[float, ...]] = {
    ("symbols", "+"): (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    ("bangs", "+"): (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    ("capitals", "+"): (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    ("dup_lines", "+"): (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    ("repeats", "+"): (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    ("word_length", "+"): (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
    ("word_length", "-"): (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5),
    ("marks", "-"): (0.005, 0.01, 0.02, 0.03, 0.05),
}
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STATS = "symbols double, bangs double, capitals double, dup_lines double, repeats double, word_length double, marks double"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Risk:
    """tuning: tenths of the labelled documents that choose cutoffs; the others certify them."""

    risk: float = 0.05
    error: float = 0.05
    good_weight: float = 20.0
    tuning: int = 3


#: Rules of a stratum, in the order in which they were tested, with their cutoffs.
Cutoffs = list[tuple[tuple[str, str], float]]


def measure(text: str | None) -> tuple:
    """The base counts and the statistics of a whole text; null counts as empty, all zero."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    chars = len(text) - sum(map(text.count, common.WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(common.WHITE)]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            covered = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(((codes - 65) < 26).sum())
    marks = sum(map(text.count, ".,;:?"))
    return (n, chars, symbols, dup, repeated, symbols / chars, text.count("!") / n, capitals / chars, dup / len(lines), repeated / n, chars / n, marks / n)


NAMES = [x.split()[0] for x in f"{BASE}, {STATS}".split(", ")]
KINDS = [pa.int64()] * 5 + [pa.float64()] * 7


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and every count and statistic of each row; nothing else is read of docs."""

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                cols = list(zip(*map(measure, part.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *map(pa.array, cols, KINDS)], names=["doc_id", "stratum", *NAMES])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum().alias("stratum"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(rows, f"doc_id long, stratum string, {BASE}, {STATS}").withColumn("base_failed", base_failed())


def stratum():
    return F.coalesce(F.col("lang").cast("string"), F.lit("?"))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly summed."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(counts: dict[tuple[str, str], list[tuple[int, int]]], risk: Risk) -> Cutoffs:
    """The best cutoff of each rule of a stratum, best rules first. counts: for each cutoff, the good and the bad tuning documents it rejects."""
    best = []
    for (name, side), pairs in counts.items():
        gain, nth = max((bad - risk.good_weight * good, -i) for i, (good, bad) in enumerate(pairs))
        if gain > 0:
            best.append((-gain, name, side, RULES[name, side][-nth]))
    return [((name, side), cutoff) for _, name, side, cutoff in sorted(best)]


def certify(lost: dict[str, list[int]], totals: dict[str, int], risk: Risk, strata: int) -> dict[str, int]:
    """How many of its rules each stratum may use. lost: good holdout documents that fall to the first rule, to one of the first two, and so on; totals: good ones."""
    out = {}
    for s, counts in lost.items():
        n, out[s] = totals.get(s, 0), 0
        for k in counts:
            # no more than expected can be certified, so the sum stays short
            if not n or k >= risk.risk * n or tail(k, n, risk.risk) > risk.error / strata:
                break
            out[s] += 1
    return out


def in_tuning(risk: Risk):
    """Whether a labelled document tunes, by a hash of its id that any SQL engine can do."""
    m = 1_000_003
    return F.pmod(F.pmod(F.col("doc_id"), F.lit(m)) * 7919, F.lit(m)) % 10 < risk.tuning


def calibrate(stats: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str, Cutoffs]:
    """Each stratum's certified rules, from all labelled documents that pass the base rules.

    labels (doc_id, quality): null ids and qualities count for nothing; of several labels the worst holds. What is
    gathered are counts, some rows per stratum; strata are languages, few by their nature.
    """
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    held = common.settle(stats.where(~F.col("base_failed")).join(truth, "doc_id").withColumn("tuning", in_tuning(risk)), "labelled")
    sums, keys = [F.count("*").alias("n")], []
    for (name, side), cuts in RULES.items():
        for c in cuts:
            keys.append((name, side))
            sums.append(F.count_if(beyond(name, side, c)).alias(f"c{len(keys)}"))
    rows = {(r.stratum, r.tuning, r.good): r for r in held.groupBy("stratum", "tuning", "good").agg(*sums).collect()}
    strata, chosen = sorted({s for s, _, _ in rows}), {}
    for s in strata:
        good, bad = rows.get((s, True, True)), rows.get((s, True, False))
        own: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, key in enumerate(keys, 1):
            own.setdefault(key, []).append((good[f"c{i}"] if good else 0, bad[f"c{i}"] if bad else 0))
        chosen[s] = choose(own, risk)
    totals = {s: rows[s, False, True].n if (s, False, True) in rows else 0 for s in strata}
    fell = {(r.stratum, r.nth): r.n for r in held.where("good AND NOT tuning").groupBy("stratum", first_hit(chosen, lambda nth, rule, c: F.lit(nth)).alias("nth")).agg(F.count("*").alias("n")).collect()}
    lost = {s: [sum(fell.get((s, j), 0) for j in range(k + 1)) for k in range(len(chosen[s]))] for s in strata}
    return {s: chosen[s][:k] for s, k in certify(lost, totals, risk, len(strata)).items() if k}


def beyond(name: str, side: str, cutoff: float):
    return F.col(name) > cutoff if side == "+" else F.col(name) < cutoff


def first_hit(cutoffs: dict[str, Cutoffs], value):
    """value(place, rule, cutoff) of the first of its stratum's rules that rejects a row; null if none does."""
    out = F.lit(None)
    for s, rules in cutoffs.items():
        hit = F.lit(None)
        for nth, (rule, c) in reversed(list(enumerate(rules))):
            hit = F.when(beyond(*rule, c), value(nth, rule, c)).otherwise(hit)
        out = F.when(F.col("stratum") == s, hit).otherwise(out)
    return out


def rejection(cutoffs: dict[str, Cutoffs]):
    """The first rule that rejects a row, with its cutoff; null if none does."""
    return first_hit(cutoffs, lambda nth, rule, c: F.lit(f"{rule[0]}{rule[1]}{c:g}")).cast("string")


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rejected_by for every row of docs.

    Null and empty texts have no words and fail. Rows that share an id or have none are judged each by its text (a null
    id is never labelled). A null language is a stratum of its own, "?". A stratum with too few labels to certify a
    cutoff rejects by the base rules only. An empty table gives no rows; other columns are not read.
    """
    stats = common.settle(measured(docs), "quality")
    out = stats.withColumn("rejected_by", F.when(~F.col("base_failed"), rejection(calibrate(stats, labels, risk))))
    return out.select("doc_id", *NAMES[:5], "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")


def filter_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of docs that are kept, with their columns, as judge() has it: null, empty and short texts go, repeated
    rows and those without an id are judged each, whatever other columns there are.

    Rows are written once with their statistics, which the calibration and the filter read; no text is measured twice
    and none leaves its place. An empty table gives no rows.
    """
    mark = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # no column of docs begins like this
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(mark + x for x in f"{BASE}, {STATS}".split(", "))).fields])

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                cols = list(zip(*map(measure, part.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, cols, KINDS)], names=[*part.schema.names, *(mark + x for x in NAMES)])

    wide = common.settle(docs.mapInArrow(rows, schema), "quality")
    plain = [F.col(mark + x).alias(x) for x in NAMES]
    stats = wide.select(F.col("doc_id").cast("long").alias("doc_id"), stratum().alias("stratum"), *plain).withColumn("base_failed", base_failed())
    gone = rejection(calibrate(stats, labels, risk))
    packed = wide.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), stratum().alias("stratum"), *plain)
    return packed.where(~base_failed() & gone.isNull()).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def oracle(risk: Risk = Risk()) -> str:
    """op1_quality_rules in DuckDB's SQL."""
    cuts = ", ".join(f"('{n}', '{side}', {k}, {c!r}, '{n}{side}{c:g}')" for (n, side), v in RULES.items() for k, c in enumerate(v))
    stats = [x.split()[0] for x in STATS.split(", ")]
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, stratum, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM doc),
win AS (SELECT r, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
often AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS c FROM win JOIN often USING (r, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(x, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT w.r, doc_id, stratum, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CASE WHEN len(w) > 0 THEN coalesce(dup, 0) ELSE 0 END AS n_dup_lines, coalesce(c, 0) AS n_repeat_words,
  length(regexp_replace(x, '[^!]', '', 'g')) AS bang, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS cap, length(regexp_replace(x, '[^.,;:?]', '', 'g')) AS mark, n AS lines FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN line ON line.r = w.r),
full_ AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / (1e0 * word_chars) AS symbols, bang / (1e0 * n_words) AS bangs, cap / (1e0 * word_chars) AS capitals, n_dup_lines / (1e0 * lines) AS dup_lines, n_repeat_words / (1e0 * n_words) AS repeats, word_chars / (1e0 * n_words) AS word_length, mark / (1e0 * n_words) AS marks FROM base),
stat AS (SELECT r, stratum, doc_id, unnest({stats}) AS name, unnest([{', '.join(stats)}]) AS v FROM full_ WHERE NOT base_failed),
cut(name, side, nth, cutoff, label) AS (VALUES {cuts}),
truth AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT f.r, f.stratum, t.good, ((doc_id % 1000003 + 1000003) % 1000003) * 7919 % 1000003 % 10 < {risk.tuning} AS tuning FROM full_ f JOIN truth t USING (doc_id) WHERE NOT base_failed),
gain AS (SELECT l.stratum, c.name, c.side, c.nth, c.cutoff, c.label, count(*) FILTER (NOT good) - {risk.good_weight}e0 * count(*) FILTER (good) AS gain FROM labelled l JOIN stat s USING (r) JOIN cut c ON c.name = s.name AND CASE c.side WHEN '+' THEN v > c.cutoff ELSE v < c.cutoff END WHERE tuning GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, name, side) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stratum, name, side ORDER BY gain DESC, nth) AS top FROM gain WHERE gain > 0) WHERE top = 1),
hit AS (SELECT s.r, min(b.place) AS place FROM stat s JOIN best b ON s.stratum = b.stratum AND s.name = b.name AND CASE b.side WHEN '+' THEN s.v > b.cutoff ELSE s.v < b.cutoff END GROUP BY s.r),
holdout AS (SELECT l.stratum, h.place FROM labelled l LEFT JOIN hit h USING (r) WHERE good AND NOT tuning),
test AS (SELECT b.stratum, b.place, count(*) FILTER (o.stratum IS NOT NULL) AS n, count(*) FILTER (o.place <= b.place) AS k FROM best b LEFT JOIN holdout o ON o.stratum = b.stratum GROUP BY ALL),
tails AS (SELECT stratum, place, sum(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + i * ln({risk.risk}e0) + (n - i) * ln(1 - {risk.risk}e0))) AS p FROM (SELECT *, unnest(generate_series(0, k)) AS i FROM test WHERE k < {risk.risk}e0 * n) GROUP BY ALL),
ok AS (SELECT t.stratum, t.place, bool_and(coalesce(p.p, 1) <= {risk.error}e0 / (SELECT count(DISTINCT stratum) FROM labelled)) OVER (PARTITION BY t.stratum ORDER BY t.place) AS certified FROM test t LEFT JOIN tails p USING (stratum, place)),
gone AS (SELECT h.r, b.label FROM hit h JOIN full_ f USING (r) JOIN ok USING (stratum, place) JOIN best b USING (stratum, place) WHERE certified)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND g.label IS NULL AS kept, g.label AS rejected_by
FROM full_ f LEFT JOIN gone g ON g.r = f.r"""
