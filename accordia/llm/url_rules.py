"""Operator 9: URL filtering by fixed rules and by association rules that FP-growth mines from labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCK = "y=block"


#: Characters of the mined rules' tokens, together, up to which the rules are sent to every task; beyond, they are joined by a shuffle.
BROADCAST_CHARS = 32 << 20


@dataclass(frozen=True)
class Mining:
    """min_count: labelled pages that hold a rule's tokens and are to be blocked, at least; min_support: the same as a
    share; the stricter holds. min_lift: the confidence (the share to be blocked of the pages with those tokens) over the
    share to be blocked of all labelled pages. min_z: how many standard deviations that chance gives the confidence
    exceeds the latter share by; 2.33 is one rule in a hundred by chance, of each rule by itself."""

    min_count: int = 3
    min_support: float = 0.002
    min_lift: float = 1.5
    min_z: float = 2.33


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ://, up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    known = url.contains("://")
    rest = url.substr(F.length(F.substring_index(url, "://", 1)) + F.lit(4), F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest fitting rule as (length, rule, verdict), or null. A rule fits its host and all subdomains."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in RULES]
    return F.array_max(F.array(*fits))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """A URL's distinct tokens: the host's labels and suffixes, path words (numbers as one token), query names, scheme."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("h="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"[^/._-]+"), F.lit(0)), lambda w: F.concat(F.lit("p="), F.when(w.rlike(r"^[0-9]+$"), "#").otherwise(w)))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda w: F.concat(F.lit("q="), w))
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.substring_index(url, "://", 1))))
    return F.when(host != "", F.array_distinct(F.concat(tails, words, names, scheme))).otherwise(F.array().cast("array<string>"))


def mine(transactions: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules (tokens array, support, confidence, token) for blocking, from rows (items, block boolean).

    token is the rarest of a rule's tokens among the rows, under which the inverted index lists it. FP-growth counts in
    the cluster, over all labelled rows; only their number, and that of those to be blocked, is collected.
    """
    spark = transactions.sparkSession
    n, blocked = transactions.agg(F.count("*"), F.count_if("block")).first()
    least = max(mining.min_support, mining.min_count / n) if n else 2.0
    if least > 1 or not blocked:
        return spark.createDataFrame([], "tokens array<string>, support double, confidence double, token string")
    base = blocked / n
    rows = transactions.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min(1.0, mining.min_lift * base)).fit(rows)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"), "support", "confidence")
    held = F.round(F.col("support") * n / F.col("confidence"))  # labelled pages with the rule's tokens
    rules = rules.where((F.col("confidence") - base) * F.sqrt(held) >= mining.min_z * (base * (1 - base)) ** 0.5)
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    ranked = rules.select("*", F.explode("tokens").alias("token")).join(often, "token")
    return ranked.groupBy("tokens", "support", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct rows (page_id, url, copies, items) with `best`, the strongest rule whose tokens they all hold, or null.

    A URL looks its tokens up in the index and compares only the rules listed there. The rules go to every task, so the
    URLs stay where they are; beyond BROADCAST_CHARS they are joined by token, and an adaptive join splits hot ones.
    """
    chars = rules.agg(F.sum(F.length(F.array_join("tokens", " ")))).first()[0] or 0
    index = rules.select("token", "confidence", "tokens")
    posted = urls.select("page_id", "url", "copies", "items", F.explode("items").alias("token"))
    posted = posted.join(F.broadcast(index) if chars <= BROADCAST_CHARS else index, "token", "left")
    rule = F.when(F.size(F.array_except("tokens", "items")) == 0, F.struct("confidence", -F.size("tokens"), F.col("tokens").alias("tokens")))
    return posted.groupBy("page_id", "url").agg(F.first("copies").alias("copies"), F.max(rule).alias("best"))


def judge(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url): the fixed rule's verdict, else block
    where a mined rule matches, else allow. mined has that rule's tokens.

    labels has (doc_id, quality, toxic), of which doc_id is a page_id: a page of bad quality or toxic is to be blocked;
    null counts as neither, and several labels of a page count as block if one is. A null url, or one without ://, has
    an empty host and path, no tokens, and is allowed. Repeated rows are each judged; equal ones are matched once.
    Without labels no rule is mined. Only URLs that no fixed rule decides are shuffled, once, by page_id and url.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    judged = rows.select("*", host.alias("host"), path.alias("path"))
    judged = judged.select("*", fixed_rule(F.col("host"), F.col("path")).alias("fixed"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    truth = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("block"))
    items = tokens(F.col("host"), F.col("path"), F.col("url"))
    labelled = judged.where(F.col("host") != "").join(truth, "page_id").select(items.alias("items"), "block")
    rules = common.settle(mine(labelled, mining), "url-rules")
    open_ = F.col("fixed").isNull() & (F.col("host") != "")
    decided = judged.where(~open_).select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    distinct = judged.where(open_).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    found = match(distinct.select("page_id", "url", "copies", tokens(*parts(F.col("url")), F.col("url")).alias("items")), rules)
    each = found.select("page_id", "url", "best", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("page_id", host.alias("host"), path.alias("path"), "best")
    verdict = F.when(F.col("best").isNotNull(), "block").otherwise("allow")
    return decided.unionByName(each.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), F.array_join("best.tokens", " ").alias("mined")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels"))


#: The same in DuckDB's SQL; the fixed rules are written out once more, mined ones come from counting every subset of a labelled URL's tokens.
ORACLE = rf"""
WITH parted AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parted),
fixed(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT s.url, max_by(f.h || f.p, length(f.h || f.p)) AS rule, max_by(f.verdict, length(f.h || f.p)) AS verdict FROM (SELECT DISTINCT url, host, path FROM split) s JOIN fixed f ON (s.host = f.h OR ends_with(s.host, '.' || f.h)) AND starts_with(s.path, f.p) GROUP BY s.url),
label AS (SELECT string_split(host, '.') AS l, * FROM split WHERE host <> ''),
item AS (SELECT page_id, url, list_distinct(list_concat(list_transform(generate_series(1, len(l)), lambda i: 'h=' || array_to_string(l[i:], '.')),
  list_transform(regexp_extract_all(lower(path), '[^/._-]+'), lambda w: 'p=' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN '#' ELSE w END), list_transform(regexp_extract_all(url, '[?&]([^=&#]+)', 1), lambda w: 'q=' || w), ['s=' || lower(split_part(url, '://', 1))])) AS items FROM label),
truth AS (SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS block FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
trans AS (SELECT list_sort(i.items) AS items, t.block FROM item i JOIN truth t ON t.doc_id = i.page_id),
least AS (SELECT ceil(greatest({Mining.min_support}e0, {Mining.min_count}e0 / count(*)) * count(*)) AS c, count(*) FILTER (block) / (1e0 * count(*)) AS base FROM trans),
part AS (SELECT block, items, unnest(generate_series(1, (1::BIGINT << len(items)) - 1)) AS mask FROM trans),
sub AS (SELECT block, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS tokens FROM part),
rules AS (SELECT tokens, count(*) FILTER (block) / (1e0 * count(*)) AS confidence FROM sub GROUP BY tokens
  HAVING count(*) FILTER (block) >= (SELECT c FROM least) AND confidence >= {Mining.min_lift}e0 * (SELECT base FROM least) AND (confidence - (SELECT base FROM least)) * sqrt(1e0 * count(*)) >= {Mining.min_z}e0 * (SELECT sqrt(base * (1 - base)) FROM least)),
hit AS (SELECT u.url, r.tokens, row_number() OVER (PARTITION BY u.url ORDER BY r.confidence DESC, len(r.tokens), r.tokens DESC) AS nth FROM (SELECT DISTINCT url, items FROM item) u JOIN rules r ON list_has_all(u.items, r.tokens))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN f.rule IS NULL THEN array_to_string(h.tokens, ' ') END AS mined
FROM split s LEFT JOIN fit f ON f.url = s.url LEFT JOIN hit h ON h.url = s.url AND h.nth = 1"""
