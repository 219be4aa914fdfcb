"""Incremental ingest of result cells: what is new since the last run, then the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import latest


def ingest(spark: SparkSession, folder: str, glob: str, schema, table: str, checkpoint: str) -> DataFrame:
    """Append files that weren't seen yet to the table's folder and return it whole. A run that is cut short goes on
    from its checkpoint; files done before are never read again."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(table)


def latest_cells(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(rows, keys, order)
