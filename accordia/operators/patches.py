"""File-aware similarity of patches: channels, shared files, union-normalised scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pairs, text


def with_grams(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Add the length {prefix}len and the n-gram sets {prefix}1..4 of a text column, dropping the text."""
    out = df.withColumn(f"{prefix}tok", F.expr(text.tokens(column))).drop(column)
    out = out.select("*", F.size(f"{prefix}tok").alias(f"{prefix}len"), *[F.expr(text.grams(f"{prefix}tok", n)).alias(f"{prefix}s{n}") for n in range(1, 5)])
    sets = [F.expr(text.occurrences(f"{prefix}s{n}")).alias(f"{prefix}{n}") for n in range(1, 5)]
    return out.select("*", *sets).drop(f"{prefix}tok", *[f"{prefix}s{n}" for n in range(1, 5)])


def channel(df: DataFrame, a: str, b: str, name: str, empty: str = "cast(NULL AS double)") -> DataFrame:
    """Add the similarity of two sides made by with_grams: `empty` if both are, 0 if one is, else symmetric BLEU."""
    got = df
    for n in range(1, 5):
        got = got.withColumn(f"m{n}", F.size(F.array_intersect(f"{a}{n}", f"{b}{n}")))
    la, lb = f"{a}len", f"{b}len"
    return got.withColumn(name, F.expr(f"CASE WHEN {la} = 0 AND {lb} = 0 THEN {empty} ELSE {text.symmetric(la, lb)} END")).drop("m1", "m2", "m3", "m4")


def decomposition(files: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """issue, i, j, main, jaccard, shared_only, calibrated for all pairs i < j from rows (issue, t, file, removed, added);
    with gold (issue, file, removed, added), for the gold patch as i = -1 against every candidate j.

    main is the sum over shared files of their score, over the size of the union; a file's score is the mean of its
    channels that aren't both empty. Pairs without a shared file score 0. Equal texts of a file are compared once; an
    issue's rows meet in one batch, so nothing is joined, and the union comes from the counts.
    """
    if gold is not None:
        files = gold.select("issue", F.lit(-1).alias("t"), "file", "removed", "added").unionByName(files.select("issue", "t", "file", "removed", "added"))
    out = pairs.file_scores(files, gold is not None)
    union = F.col("ca") + F.col("cb") - F.col("shared")
    alone = F.when(F.col("shared") > 0, F.col("total") / F.col("shared")).otherwise(0.0)
    return out.select("issue", "i", "j", (F.col("total") / union).alias("main"), (F.col("shared") / union).alias("jaccard"), alone.alias("shared_only"), (F.col("warm") / union).alias("calibrated"))


def gold_scores(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """issue, t, score: symmetric BLEU of each candidate (issue, t, added) against its issue's gold text."""
    texts = with_grams(candidates.select("issue", "added").distinct().withColumn("text", F.col("added")), "text", "b")
    scores = channel(texts.join(with_grams(gold, "gold", "a"), "issue"), "a", "b", "score", "1D").select("issue", "added", "score")
    return candidates.select("issue", "t", "added").join(scores, ["issue", "added"]).select("issue", "t", "score")
