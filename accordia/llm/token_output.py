"""Operator 5: documents as token ids in binary files of patched frame-of-reference blocks, in doc_id order."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pfor
from .bpe import encoder, with_ends

TOKENIZER, END = "word_bpe_49k.json", 2
#: Ids gathered before a file is closed; a longer document makes a longer file.
FILE_IDS = 2_000_000
#: Words a worker remembers the ids of.
WORDS = 800_000
MANIFEST = "part long, file long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text (null: empty), append end_id to each and write the ids below folder, ascending by doc_id.

    Null ids come first; rows that share an id keep an order by their text's hash, and each is a document of its own.
    An empty table writes nothing. Other columns, whatever their names, are not read. Returns one row per file
    (part, file, path, n_docs, n_ids), to be read in that order; the files are written when the result is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")

    def write(batches):
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, WORDS)
        file, ids, keys, lengths, held = 0, [], [], [], 0

        def close():
            path = f"{folder}/part-{part:06d}-{file:06d}.pfb"
            common.write_file(path, pfor.pack_file(np.concatenate(ids), keys, np.array(lengths, np.int64)))
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "path": [path], "n_docs": [len(keys)], "n_ids": [held]}, schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for piece in common.slices(batch, "text"):
                got, n = with_ends(*enc.encode(piece.column("text")), end_id)
                own, ends, a, done = piece.column("doc_id").to_pylist(), np.cumsum(n), 0, 0
                while a < len(n):
                    # as many documents as fill the file
                    b = min(int(np.searchsorted(ends, done + file_ids - held)) + 1, len(n))
                    ids.append(got[done : ends[b - 1]])
                    keys += own[a:b]
                    lengths += n[a:b].tolist()
                    held += int(ends[b - 1]) - done
                    a, done = b, int(ends[b - 1])
                    if held >= file_ids:
                        yield close()
                        file, ids, keys, lengths, held = file + 1, [], [], [], 0
        if keys:
            yield close()

    return rows.select("doc_id", "text").mapInArrow(write, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """Add base: the ids in all files before. Sums run within a part; only one total for each part reaches the driver's plan."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    return manifest.withColumn("within", within).join(before, "part").withColumn("base", F.col("within") + F.col("before")).drop("within", "before")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, keys, lengths = pfor.unpack_file(common.read_file(path))
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": pa.array(base + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    manifest = common.settle(write_tokens(docs, common.shared_dir(spark, "tokens")), "manifest")
    return read_tokens(with_bases(manifest))
