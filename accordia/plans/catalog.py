"""Every query of the analytics side by name, with the SQL that DuckDB checks it against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from . import facts, oracle_base, reports

FACTS = ("candidate", "pair", "issue", "label", "sim", "cluster", "ranked", "selection")


def _upto(sql: str) -> str:
    """The last fact table that a report or what it builds on reads."""
    text = sql
    seen: set[str] = set()
    while more := [n for n in reports.DERIVED if n not in seen and re.search(rf"\b{n}\b", text)]:
        seen |= set(more)
        text += "".join(reports.DERIVED[n] for n in more)
    return next((n for n in ("selection", "cluster", "label", "issue", "pair", "candidate") if re.search(rf"\b(FROM|JOIN) {n}\b", text)), "candidate")


def run_report(spark: SparkSession, name: str, make: Callable[[str], object]) -> DataFrame:
    """The report over views that make(last fact table) registers."""
    text = sql = reports.REPORTS[name]
    upto = _upto(sql)
    make("issue" if upto == "candidate" else upto)
    derived: list[str] = []
    while more := [n for n in reports.DERIVED if n not in derived and re.search(rf"\b(FROM|JOIN) {n}\b", text)]:
        derived += more
        text += "".join(reports.DERIVED[n] for n in more)
    for n in [n for n in reports.DERIVED if n in derived]:
        df = spark.sql(reports.spell(reports.DERIVED[n], True))
        if n == "tables2x2" and "odds" in derived:  # which reads it several times over
            df = files.settle(df, n)
        (df if n in reports.CONSTANT else df.hint("merge")).createOrReplaceTempView(n)
    return spark.sql(reports.spell(sql, True))


def report(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_report(spark, name, lambda upto: facts.tables(spark, sf_dir, upto))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more

    return {name: report(name) for name in reports.REPORTS} | more.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import more

    return {name: reports.spell(oracle_base.with_tables(sql, reports.DERIVED | oracle_base.DERIVED), False) for name, sql in reports.REPORTS.items()} | more.ORACLES
