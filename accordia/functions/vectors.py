"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """To length one; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a.cast("array<double>"), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def calibrated(score: Column) -> Column:
    """exp(-(1 - score) / 0.5)."""
    return F.exp(-(1 - score) / 0.5)


def weighted_pool(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Weighted mean of a group's vectors, scaled to length one: keys, pooled."""
    cells = rows.select(*keys, F.col(weight).cast("double").alias("w"), F.posexplode(F.col(vector)).alias("p", "x"))
    means = cells.groupBy(*keys, "p").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    arrays = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda c: c["x"]).alias("v"))
    return arrays.select(*keys, unit(F.col("v")).alias("pooled"))


def even_chunks(tokens: Column, most: int) -> Column:
    """A token array in the fewest chunks of at most `most`, as even as can be; none for no tokens."""
    n = F.size(tokens)
    k = F.ceil(n / F.lit(most)).cast("int")
    edges = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1))), lambda i: F.floor(i * n / F.greatest(k, F.lit(1))).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.slice(tokens, F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def cache_misses(wanted: DataFrame, cache: DataFrame, text: str, version: str) -> DataFrame:
    """Distinct texts, by hash and configuration, that the cache doesn't have yet."""
    keyed = wanted.select(F.sha2(F.col(text), 256).alias("sha256"), F.lit(version).alias("config"), text).dropDuplicates(["sha256", "config"])
    return keyed.join(cache.select("sha256", "config"), ["sha256", "config"], "left_anti")


def greedy_chunks(text: str, room: int, count) -> list[str]:
    """Prefixes of a text that hold at most `room` tokens by count(text), each as long as fits (found by bisection), and
    ending at a line end where one lies in its last fifth."""
    out = []
    while text:
        low, high = 1, len(text)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[:mid]) <= room else (low, mid - 1)
        if low < len(text) and (cut := text.rfind("\n", int(low * 0.8), low)) > 0:
            low = cut + 1
        out.append(text[:low])
        text = text[low:]
    return out


def request_batches(items, most: int, budget: int):
    """(key, tokens) pairs in order, in lists of at most `most` items and `budget` tokens; one larger item goes alone."""
    held, used = [], 0
    for item in items:
        if held and (len(held) == most or used + item[1] > budget):
            yield held
            held, used = [], 0
        held.append(item)
        used += item[1]
    if held:
        yield held
