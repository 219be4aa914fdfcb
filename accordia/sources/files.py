"""Readers and writers of the file layouts that candidate studies use, and tables settled in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset, below a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="facts-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back, so that reports share one computation of it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_texts(spark: SparkSession, path: str, pattern: str, *keys: str) -> DataFrame:
    """Text files, one row each, with keys taken from their paths by the groups of `pattern`."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select("path", "text", *[F.regexp_extract("path", pattern, i).alias(k) for i, k in enumerate(keys, 1)])


def first_json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of each JSON-lines file the first line that isn't blank, as columns of `schema`; broken ones give nulls."""
    rows = spark.read.text(path, recursiveFileLookup=True, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    line = F.trim(F.regexp_extract("value", r"^\s*([^\n]*)", 1))
    return rows.select("path", F.from_json(line, schema).alias("v")).select("path", "v.*")


def string_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose columns all stay strings, so that a pattern such as 11 isn't taken for a number."""
    return spark.read.csv(path, header=True, inferSchema=False)


def first_column(df: DataFrame, *names: str) -> str:
    """The first of these columns that df has."""
    return next(n for n in names if n in df.columns)


def concat_shards(*shards: DataFrame) -> DataFrame:
    """Shards of a result matrix as one, missing columns null, ordered by repository and issue."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("repo", "instance_id")


def unpivot_temperatures(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Columns such as Temp_0.3_oracle or temp_0.3 as rows with the temperature in tenths."""
    cols = [c for c in df.columns if c.lower().startswith("temp_")]
    long = df.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`").cast("string").alias(c) for c in cols], "column", value)
    return long.withColumn("t", F.round(F.regexp_extract("column", r"(\d+\.\d+)", 1).cast("double") * 10).cast("int")).drop("column")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with NA for null, for small reports."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="NA")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_matrix(pairs: DataFrame, path: str, keys: list[str]) -> None:
    """Symmetric matrices with unit diagonals, one CSV row per candidate, partitioned by keys. pairs: keys, i, j, score.
    The columns are all candidates that occur, in their order."""
    both = pairs.select(*keys, "i", "j", "score").unionByName(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    diagonal = both.select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("score")).distinct()
    wide = both.unionByName(diagonal).groupBy(*keys, "i").pivot("j").agg(F.first("score"))
    wide.write.mode("overwrite").partitionBy(*keys).csv(path, header=True)


def candidate_cells(results: DataFrame, syntax: DataFrame, key: str = "instance_id") -> DataFrame:
    """key, t, status, syntax of the cells of a result matrix that the syntax matrix has too. Of an id that a matrix lists
    more than once its least row, as text, counts; the keys and the temperature columns are all that is read."""

    def cells(df: DataFrame, value: str) -> DataFrame:
        cols = [c for c in df.columns if c.lower().startswith("temp_")]
        once = df.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])).alias("r")).select(key, "r.*")
        return unpivot_temperatures(once, [key], value)

    return cells(results, "status").join(cells(syntax, "syntax"), [key, "t"])


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under other names too: each missing column of `aliases` (name: the name it may have instead) is added.
    Names that differ by case only are the same to Spark."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.col(f"`{other}`").alias(name) for name, other in aliases.items() if name.lower() not in have and other.lower() in have])


def lookup(df: DataFrame, instances: DataFrame, columns: list[str], key: str = "instance_id") -> DataFrame:
    """df with these columns of its instance; an id that instances lack, or have twice, is an error."""
    known = instances.groupBy(F.trim(F.col(key).cast("string")).alias("_id")).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    out = df.withColumn("_id", F.trim(F.col(key).cast("string"))).join(known, "_id", "left")
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("no instance or several: "), F.coalesce("_id", F.lit("null")))).cast("boolean"))
    return out.where(ok).drop("_id", "_n")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of repeated partial results the latest of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def latex_table(df: DataFrame, label: str, columns: list[str]) -> str:
    """Rows of a small report as lines of a LaTeX table: three decimals, -- for null."""
    cells = [F.coalesce(F.format_string("%.3f", F.col(c).cast("double")), F.lit("--")) for c in columns]
    lines = df.select(label, F.concat_ws(" & ", label, *[F.when(F.col(c).isNull(), "--").otherwise(x) for c, x in zip(columns, cells, strict=True)]).alias("line")).orderBy(label)
    return "\n".join(r.line + " " + 2 * chr(92) for r in lines.collect())
