"""A study of one's own candidates: every report over them, and all of them written out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import catalog, facts, reports

COLUMNS = ("issue", "repo", "lang", "t", "v", "removed", "added", "status", "syntax")


class Study:
    """candidates: issue, t (temperature in tenths), added, status, syntax, and if there are any repo, lang, v, removed.

    status is a raw result (1, 0, MISSING, ...), in any spelling that normalise() knows. pairs, if given, has issue, i, j
    (i < j) and score from any metric; without it, candidates are compared by symmetric BLEU of their added text.
    """

    def __init__(self, spark: SparkSession, candidates: DataFrame, pairs: DataFrame | None = None):
        self.spark, self.pairs, self.key = spark, pairs, uuid.uuid4().hex
        have = candidates.columns
        blank = {"repo": F.lit(""), "lang": F.lit(""), "v": F.lit(0), "removed": F.lit("")}
        cols = [(F.col(c) if c in have else blank[c]).alias(c) for c in COLUMNS]
        self.source = candidates.select(*cols).withColumn("status", normalise(F.col("status"))).withColumn("added", F.coalesce("added", F.lit(""))).selectExpr("*", f"{facts.VALID} AS valid")

    def table(self, name: str) -> DataFrame:
        """One of the fact tables: candidate, pair, issue, label, cluster, selection."""
        return self._make(name)[name]

    def report(self, name: str) -> DataFrame:
        return catalog.run_report(self.spark, name, self._make)

    def write(self, folder: str, names: list[str] | None = None) -> None:
        """Reports as CSV files with NA for null, each in a folder of its name."""
        for name in names or reports.REPORTS:
            files.write_csv(self.report(name), f"{folder}/{name}")

    def _make(self, upto: str) -> dict[str, DataFrame]:
        return facts.tables(self.spark, self.key, upto, self.source, self.pairs)


def normalise(status):
    """1 and 1.0 as 1, 0 and 0.0 as 0, null as NaN, all else trimmed."""
    s = F.trim(status.cast("string"))
    return F.when(s.isNull(), "NaN").when(s.isin("1", "1.0"), "1").when(s.isin("0", "0.0"), "0").otherwise(s)
