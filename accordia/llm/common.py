"""What the operators share: scratch tables in the cluster's shared folder, files, hashing."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import os
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Of an Arrow batch between Spark and Python: rows here are texts of very different lengths.
BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound the bytes of their batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset, below a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once into the shared folder and read it back: later plans neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; plain paths are local."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under another name and move into place, so that a lost or repeated task never shows half a file."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


PAGE = os.sysconf("SC_PAGE_SIZE")
_fetched: dict[str, str] = {}
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and ctypes.util.find_library("c") else None


def mapped(uri: str) -> np.ndarray:
    """The file as memory-mapped bytes; from a remote store by way of a copy that goes when the worker ends."""
    fs, path = open_fs(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        if uri not in _fetched:
            top = tempfile.mkdtemp(prefix="levels-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
            _fetched[uri] = os.path.join(top, "level")
            with open(_fetched[uri], "wb") as out:
                out.write(read_file(uri))
        path = _fetched[uri]
    return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit integers."""
    x = np.asarray(x, np.uint64) + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow string array without nulls; the same on every machine."""
    if not len(values):
        return np.zeros(0, np.uint64)
    values = values.cast(pa.large_binary())
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    start, size = offsets[:-1], np.diff(offsets)
    out = mix(size.astype(np.uint64))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    live = np.flatnonzero(size > 0)
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        word = padded[(start[live] + at)[:, None] + np.arange(8)]
        word[np.arange(8)[None, :] >= left[:, None]] = 0
        out[live] = mix(out[live] ^ np.ascontiguousarray(word).view("<u8")[:, 0]) * _M3 + _M2
        at += 8
        live = live[size[live] > at]
    return mix(out)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of each text (null: none): of each word its text's index and its code, and the distinct words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    owner, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.not_equal(words, "")
    owner, words = owner.filter(full), words.filter(full)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(owner).astype(np.int64), np.asarray(coded.indices).astype(np.int64), coded.dictionary


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), one after another, and where each starts, with the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Of the strings between consecutive cuts of UTF-8 bytes, each one's code, and the distinct strings by code."""
    if len(cuts) < 2:
        return np.zeros(0, np.int64), []
    raw, cuts = np.ascontiguousarray(raw), np.ascontiguousarray(cuts, np.int64)
    coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return flat[at]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """The batch in runs of rows whose texts have about `most` bytes together; one longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    if not len(size):
        return
    run = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    trim()


def trim(most_mb: int = 450) -> None:
    """Give freed memory back to the system once the worker holds that much: it lives on for other stages."""
    if _libc is None:
        return
    with open("/proc/self/statm") as f:
        held = int(f.read().split()[1]) * PAGE
    if held > most_mb << 20:
        pa.default_memory_pool().release_unused()
        _libc.malloc_trim(0)
