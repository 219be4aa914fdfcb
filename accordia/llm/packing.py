"""Operator 7: documents into fixed-length sequences, planned best-fit on the histogram of their pieces' lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import encoder, with_ends

TOKENIZER, END, ROOM = "byte_bpe_50k.json", 0, 2048
#: Bytes of texts that are encoded at once; the arrays made of them are many times as large, in each of an executor's workers.
SLICE = 1 << 20
#: Runs of the plan that are sent to every task, at most; more are joined by blocks of ranks.
SENT = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, local long"


def cut(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END, room: int = ROOM) -> DataFrame:
    """Pieces of at most `room` ids of every text (null: empty) with its end_id; of a longer document the first may be shorter.

    chunk and local: a task, and the piece's rank among those of its length there. Rows that share an id, or have
    none, are documents of their own. Columns besides doc_id and text are not read.
    """

    def pieces(batches):
        chunk, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        enc = encoder(tokenizer)
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                ids, n = with_ends(*enc.encode(part.column("text")), end_id)
                raw, base = memoryview(ids.tobytes()), np.cumsum(n) - n
                k = -(-n // room)
                of = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
                first = n - room * (k - 1)
                start = np.where(piece == 0, 0, first[of] + room * (piece - 1))
                length = np.where(piece == 0, first[of], room)
                crc = [zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip((base[of] + start).tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.flatnonzero(np.diff(by, prepend=-1))
                run = np.diff(np.append(new, len(by)))
                local = np.empty(len(by), np.int64)
                local[order] = np.arange(len(by)) - np.repeat(new, run) + seen[by]
                seen[by[new]] += run
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(of)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "chunk": pa.array(np.full(len(of), chunk)), "local": pa.array(local)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, count, first sequence, offset, per sequence).

    Rank first+i of that length goes to sequence first+i//per, at offset+(i%per)*length. Work and runs follow the
    number of lengths and of open groups of equal sequences, never the number of documents.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, count)
    left: list[int] = []  # ascending, with groups

    def put(rest: int, first: int, count: int) -> None:
        if rest and count:
            if rest not in groups:
                groups[rest] = []
                insort(left, rest)
            groups[rest].append((first, count))

    made = 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            k = bisect_left(left, length)
            if k == len(left):
                break
            rest = left[k]
            first, count = groups[rest].pop()
            if not groups[rest]:
                del groups[rest], left[k]
            use = min(count, todo)
            if use < count:
                put(rest, first + use, count - use)
            runs.append((length, rank, use, first, room - rest, 1))
            put(rest - length, first, use)
            todo, rank = todo - use, rank + use
        if todo:
            per = room // length
            full, over = divmod(todo, per)
            if full:
                runs.append((length, rank, full * per, made, 0, per))
                put(room - per * length, made, full)
            if over:
                runs.append((length, rank + full * per, over, made + full, 0, per))
                put(room - over * length, made + full, 1)
            made += full + (over > 0)
    return runs


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END, room: int = ROOM) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram (at most `room` rows) reaches the driver. Ranks within a length come from counts by task, and the
    plan's runs go to the pieces (by blocks of ranks if there are more than SENT), so a length that a third of all
    pieces share needs no task of its own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = common.settle(cut(docs, tokenizer, end_id, room), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")
    bases = counts.select("length", "chunk", before.alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(histogram, room)
    runs = spark.createDataFrame(planned, "length long, first long, count long, sequence long, at long, per long")
    ranked = pieces.join(bases, ["length", "chunk"]).withColumn("rank", F.col("local") + F.col("before"))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    if len(planned) <= SENT:
        placed = ranked.join(F.broadcast(runs), "length").where(inside)
    else:
        size = max(1, sum(histogram.values()) // 2000)
        blocks = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("count") - 1) / size)))
        placed = ranked.withColumn("block", F.floor(F.col("rank") / size)).join(runs.withColumn("block", blocks), ["length", "block"]).where(inside)
    nth = F.col("rank") - F.col("first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
