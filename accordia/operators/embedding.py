"""Vector similarity of patches: each distinct channel text is embedded once, in batches, and kept by its hash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pairs, vectors

#: Pairs whose cosines are taken at once.
PAIRS = 20_000


class Provider(Protocol):
    """Turns texts into vectors of one length; is pickled to the executors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Hashing:
    """A stand-in without a model: signed counts of hashed words, scaled to length one."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for w in text.split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed_texts(texts: DataFrame, provider: Provider, config: str, most: int = 1000, budget: int = 115_000) -> DataFrame:
    """sha256, config, embedding of a frame with (sha256, text); requests hold at most `most` texts and `budget` words."""

    def run(frames):
        for frame in frames:
            items = list(zip(zip(frame["sha256"], frame["text"], strict=True), (len(x.split()) for x in frame["text"]), strict=True))
            for batch in vectors.request_batches(items, most, budget):
                got = provider.embed([t for (_, t), _ in batch])
                yield pd.DataFrame({"sha256": [k for (k, _), _ in batch], "config": config, "embedding": got})

    return texts.select("sha256", "text").mapInPandas(run, "sha256 string, config string, embedding array<double>")


def channel_vectors(files: DataFrame, provider: Provider, config: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The files with r and a, the vectors of their channels (null for blank ones), and what is new for the cache."""
    long = files.select(F.explode(F.array("removed", "added")).alias("text")).where(F.trim("text") != "")
    keyed = long.select(F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["sha256"])
    todo = keyed if cache is None else keyed.join(cache.where(F.col("config") == config), "sha256", "left_anti")
    new = embed_texts(todo, provider, config)
    known = (new if cache is None else new.unionByName(cache.where(F.col("config") == config))).select("sha256", "embedding")
    out = files
    for name, short in (("removed", "r"), ("added", "a")):
        key = F.when(F.trim(name) != "", F.sha2(name, 256)).alias("sha256")
        out = out.withColumn("sha256", key).join(known.withColumnRenamed("embedding", short), "sha256", "left").drop("sha256")
    return out, new


def _cosines(vectors_: np.ndarray, blank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the vectors a and b, clipped; NaN where both are blank, 0 where one is, or where a vector is zero."""
    out = np.zeros(len(a))
    norms = np.sqrt((vectors_ * vectors_).sum(1))
    for k in range(0, len(a), PAIRS):
        x, y = a[k : k + PAIRS], b[k : k + PAIRS]
        n = norms[x] * norms[y]
        out[k : k + PAIRS] = np.where(n == 0, 0.0, np.clip(np.einsum("ij,ij->i", vectors_[x], vectors_[y]) / np.where(n == 0, 1, n), -1, 1))
    return np.where(blank[a] & blank[b], np.nan, np.where(blank[a] | blank[b], 0.0, out))


def _by_vector(column, row, group, groups, x, y):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.asarray(pc.is_valid(column))
    known = column.filter(pa.array(there))
    own = np.array(known.flatten(), np.float64).reshape(len(known), -1) if len(known) else np.zeros((0, 1))
    table = np.concatenate([own, np.zeros((1, own.shape[1]))])
    place = np.where(there, np.cumsum(there) - 1, len(own))[row]
    return _cosines(table, np.arange(len(table)) == len(own), place[x], place[y])


def _by_text(provider: Provider, most: int, budget: int) -> Callable:
    def compare(column, row, group, groups, x, y):
        coded = pairs.strings(column).dictionary_encode()
        texts = coded.dictionary.to_pylist()
        blank = np.array([not s.strip(" ") for s in texts], bool)
        vectors_: list[list[float]] = []
        for batch in vectors.request_batches([(s, len(s.split())) for s, no in zip(texts, blank.tolist(), strict=True) if not no], most, budget):
            vectors_ += provider.embed([s for s, _ in batch])
        table = np.zeros((len(texts), len(vectors_[0]) if vectors_ else 1))
        if vectors_:
            table[~blank] = vectors_
        place = np.asarray(coded.indices).astype(np.int64)[row]
        return _cosines(table, blank, place[x], place[y])

    return compare


def _shares(out: DataFrame) -> DataFrame:
    union = F.col("ca") + F.col("cb") - F.col("shared")
    return out.select("issue", "i", "j", (F.col("warm") / union).alias("main"), (F.col("shared") / union).alias("jaccard"), F.when(F.col("shared") > 0, F.col("warm") / F.col("shared")).otherwise(0.0).alias("shared_only"), (F.col("total") / union).alias("raw"))


def decomposition(files: DataFrame) -> DataFrame:
    """issue, i, j, main, jaccard, shared_only, raw from rows (issue, t, file, r, a). A file's score is the mean cosine of
    the channels that aren't blank on both sides, 0 where one is; main is over the calibrated scores, raw over the plain."""
    return _shares(pairs.file_scores(files, channels=("r", "a"), compare=_by_vector))


def text_decomposition(files: DataFrame, provider: Provider, most: int = 1000, budget: int = 115_000) -> DataFrame:
    """decomposition() of rows (issue, t, file, removed, added), embedded where they are compared: vectors are neither shuffled
    nor joined. A batch of issues has each of its channel's texts embedded once; a text of several batches is embedded in
    each, so where that is dear, channel_vectors() and a cache come first."""
    return _shares(pairs.file_scores(files, compare=_by_text(provider, most, budget)))
