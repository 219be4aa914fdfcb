"""Operator 4: language-model scores from an Elias-Fano n-gram trie in memory-mapped files.

Level one is the vocabulary: the words' 64-bit hashes, ascending, in shards by their first bits, with exact counts; a
word's id is its rank. Level two holds the bigrams, in shards by a hash of both words, so that no word makes a shard
large. A shard lists its contexts (ids, Elias-Fano), monotone pointers to where each one's successors begin, and the
successors: relative to their context's base, the context's rank times the vocabulary, they ascend throughout and are
one Elias-Fano sequence. A successor is searched among those between its context's pointers. Each has its smoothed
probability, discounted and quantised to a byte; each word has its back-off weight, a byte too.

All counts cover all training documents. Executors write the files into the shared folder and map them from there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix
from .langid import held_out

DISCOUNT = 0.75
#: Tokens counted by a task before it hands its counts on.
GATHER = 3_000_000
#: Characters of input for each bigram shard, and for each vocabulary shard.
SHARD_CHARS, VOCAB_CHARS = 12_000_000, 100_000_000
#: Shards that a task keeps mapped; the one mapped first goes first.
MAPPED = 4000
#: The word that ends a document has a hash of its own.
END = np.uint64(0x5EED_0E0D_0000_0001)
#: Quantised log10 values reach down to this.
FLOOR = -12.0
ONE = np.uint64(1)
#: select[byte, k]: the place of the k-th one in a byte.
SELECT = np.array([[p[k] if k < len(p) else 8 for k in range(8)] for p in ([i for i in range(8) if b >> i & 1] for b in range(256))], np.uint8)


def quantise(log10: np.ndarray) -> np.ndarray:
    """Log10 probabilities as bytes, evenly between FLOOR and 0; off by no more than half a step, 0.024."""
    return np.rint(np.clip(log10, FLOOR, 0) * (255 / FLOOR)).astype(np.uint8)


LEVELS = 10.0 ** (np.arange(256) * (FLOOR / 255))


class EliasFano:
    """A monotone sequence below `universe`: low bits packed, high bits in unary; over an array of bytes, which may be mapped."""

    HEAD = struct.Struct("<QQQ")

    @staticmethod
    def build(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        lows = v & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        words = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, lows << shift)
            over = np.flatnonzero(shift.astype(np.int64) + low_bits > 64)
            np.bitwise_or.at(words, word[over] + 1, lows[over] >> (np.uint64(64) - shift[over]))
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) + 1 if n else 0) // 64 + 2
        bits = np.zeros(size * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high.view("<u8")))]).astype("<u4")
        return b"".join([EliasFano.HEAD.pack(n, low_bits, size), words.astype("<u8").tobytes(), high.tobytes(), rank.tobytes()])

    def __init__(self, raw: np.ndarray, at: int = 0):
        self.n, self.low_bits, size = self.HEAD.unpack(bytes(raw[at : at + self.HEAD.size]))
        at += self.HEAD.size
        n_low = self.n * self.low_bits // 64 + 2
        self.low = np.frombuffer(raw, "<u8", n_low, at)
        self.high = np.frombuffer(raw, "<u8", size, at + 8 * n_low)
        self.rank = np.frombuffer(raw, "<u4", size + 1, at + 8 * (n_low + size))
        self.end = at + 8 * (n_low + size) + 4 * (size + 1)
        self.zeros = 64 * np.arange(size + 1, dtype=np.int64) - self.rank

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        x = x | np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return x & np.uint64((1 << self.low_bits) - 1)

    def _in_word(self, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one (from 0) of each word."""
        parts = np.ascontiguousarray(words).astype("<u8")[:, None].view(np.uint8)
        upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
        byte = np.minimum((upto <= k[:, None]).sum(axis=1), 7)
        row = np.arange(len(words))
        before = np.where(byte > 0, upto[row, byte - 1], 0)
        return byte * 8 + SELECT[parts[row, byte], np.minimum(k - before, 7)]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        w = np.searchsorted(self.rank, i, side="right") - 1
        one = 64 * w + self._in_word(self.high[w], i - self.rank[w])
        return ((one - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h: one less than h zeros of the unary part come before them."""
        out = np.zeros(len(h), np.int64)
        k = h - 1  # the zero that ends bucket h-1
        inside = (h > 0) & (k < self.zeros[-1])
        w = np.searchsorted(self.zeros, k[inside], side="right") - 1
        zero = 64 * w + self._in_word(~self.high[w], k[inside] - self.zeros[w])
        out[inside] = zero - k[inside]
        out[(h > 0) & ~inside] = self.n
        return np.minimum(out, self.n)

    def find(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Places of the values x, between the places low and high if given; -1 where there is none."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        a, b = self.bucket(h), self.bucket(h + 1)
        if low is not None:
            a, b = np.maximum(a, low), np.minimum(b, high)
        want = x & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(a < b)
        a, b = a.copy(), b.copy()
        while len(live):  # the low bits ascend within a bucket
            mid = (a[live] + b[live]) >> 1
            got = self.lows(mid)
            hit = got == want[live]
            out[live[hit]] = mid[hit]
            less = got < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[~hit & (a[live] < b[live])]
        return out


# ---- counts on their way between tasks: ascending keys as differences, deflated


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = d[:, None].view(np.uint8).T.tobytes() + counts.astype("<u4")[:, None].view(np.uint8).T.tobytes()
    return struct.pack("<I", len(keys)) + zlib.compress(planes, 1)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    raw = np.frombuffer(zlib.decompress(data[4:]), np.uint8)
    d = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8")[:, 0]
    return np.cumsum(d, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each token's text and hash, an end after each text's words."""
    owner, code, words = common.split_words(texts, True)
    h = common.hash_strings(words)[code] if len(code) else np.zeros(0, np.uint64)
    n = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(h) + len(texts), END, np.uint64)
    of = np.repeat(np.arange(len(texts)), n + 1)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = h
    return of, out


def shards_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


# ---- the model


@dataclass(frozen=True)
class Files:
    """Where a trained model is. bases: of each vocabulary shard, the id of its first word and the one after its last."""

    folder: str
    vocab: int
    bigrams: int
    bases: tuple[int, ...]
    total: int

    @property
    def words(self) -> int:
        return self.bases[-1]


class Vocabulary:
    """Level one: hash to id, and counts by id."""

    def __init__(self, files: Files):
        self.files = files
        self.shards: dict[int, tuple[EliasFano, np.ndarray, np.ndarray]] = {}

    def shard(self, s: int) -> tuple[EliasFano, np.ndarray]:
        if s not in self.shards:
            if len(self.shards) >= MAPPED:
                del self.shards[next(iter(self.shards))]
            raw = common.mapped(f"{self.files.folder}/words-{s}.ef")
            keys = EliasFano(raw)
            self.shards[s] = keys, np.frombuffer(raw, "<u8", keys.n, keys.end)
        return self.shards[s]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of distinct hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        s = vocab_shard(h, self.files.vocab)
        for k in np.unique(s).tolist():
            if self.files.bases[k] == self.files.bases[k + 1]:
                continue
            own = np.flatnonzero(s == k)
            keys, c = self.shard(k)
            at = keys.find(h[own] >> ONE)
            ok = at >= 0
            ids[own[ok]] = at[ok] + self.files.bases[k]
            counts[own[ok]] = c[at[ok]].astype(np.int64)
        return ids, counts

    def backoff(self, ids: np.ndarray) -> np.ndarray:
        """Back-off weights of known ids."""
        out = np.ones(len(ids))
        s = np.searchsorted(np.array(self.files.bases), ids, side="right") - 1
        for k in np.unique(s).tolist():
            own = np.flatnonzero(s == k)
            raw = common.mapped(f"{self.files.folder}/backoff-{k}.q")
            out[own] = LEVELS[raw[ids[own] - self.files.bases[k]]]
        return out


def vocab_shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Bigrams:
    """A shard of level two."""

    def __init__(self, raw: np.ndarray):
        self.words = int.from_bytes(bytes(raw[:8]), "little")
        self.contexts = EliasFano(raw, 8)
        self.pointers = EliasFano(raw, self.contexts.end)
        self.successors = EliasFano(raw, self.pointers.end)
        self.probs = np.frombuffer(raw, np.uint8, self.successors.n, self.successors.end)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The shard of ascending keys (context id << 32 | word id), and its contexts with their numbers of successors."""
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(context, prepend=-1) != 0)
        own = np.diff(np.append(new, len(keys)))
        rank = np.repeat(np.arange(len(new)), own)
        probs = quantise(np.log10(np.maximum(counts - DISCOUNT, 1e-300) / context_counts))
        parts = [words.to_bytes(8, "little"), EliasFano.build(context[new], max(words, 1)), EliasFano.build(np.append(new, len(keys)), len(keys) + 1), EliasFano.build(rank * words + word, max(1, len(new) * words)), probs.tobytes()]
        return b"".join(parts), context[new], own

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Discounted probabilities; 0 where the pair isn't known."""
        out = np.zeros(len(context))
        r = self.contexts.find(context.astype(np.uint64))
        ok = np.flatnonzero(r >= 0)
        if len(ok):
            low, high = self.pointers.get(r[ok]).astype(np.int64), self.pointers.get(r[ok] + 1).astype(np.int64)
            at = self.successors.find((r[ok] * self.words + word[ok]).astype(np.uint64), low, high)
            hit = at >= 0
            out[ok[hit]] = LEVELS[self.probs[at[hit]]]
        return out


def _pieces(batches, column: str = "text"):
    for batch in batches:
        yield from common.slices(batch, column, 6 << 20)


def _blobs(kind: str):
    return pa.schema([("shard", pa.int64()), (kind, pa.binary())])


def _emit(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    ids = np.unique(shard).tolist()
    return pa.RecordBatch.from_pydict({"shard": pa.array(ids, pa.int64()), "counts": pa.array([pack_counts(keys[own], counts[own]) for own in (np.flatnonzero(shard == s) for s in ids)], pa.binary())}, schema=_blobs("counts"))


def train(docs: DataFrame) -> Files:
    """Count and write the model of the rows' texts. Null texts count as empty: an end alone. Without rows: no words.

    Tasks hand on blobs of sorted counts, one for each shard, so no word or pair is a hot key. What the driver gets is
    the number of words of each vocabulary shard.
    """
    spark = docs.sparkSession
    folder = common.shared_dir(spark, "ngrams")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    vocab, shards = 1 + chars // VOCAB_CHARS, 1 + chars // SHARD_CHARS

    def count_words(batches):
        held, n = [], 0
        for part in _pieces(batches):
            h, c = np.unique(tokens(part.column(0))[1], return_counts=True)
            held.append((h, c))
            n += len(h)
            if n > GATHER:
                keys, counts = merge_counts(held)
                yield _emit(keys, counts, vocab_shard(keys, vocab))
                held, n = [], 0
        if held:
            keys, counts = merge_counts(held)
            yield _emit(keys, counts, vocab_shard(keys, vocab))

    def write_words(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        keys, counts = merge_counts([unpack_counts(x) for x in t.column("counts").to_pylist()])
        # a bit less than the hash, so that a sequence's universe fits in 64 bits
        keys, counts = merge_counts([(keys >> ONE, counts)])
        common.write_file(f"{folder}/words-{shard}.ef", EliasFano.build(keys, 1 << 63) + counts.astype("<u8").tobytes())
        return pa.table({"shard": [shard], "words": [len(keys)], "total": [int(counts.sum())]})

    sizes = texts.mapInArrow(count_words, "shard long, counts binary").groupBy("shard").applyInArrow(write_words, "shard long, words long, total long").collect()
    by = {r.shard: r.words for r in sizes}
    bases = tuple(int(x) for x in np.concatenate([[0], np.cumsum([by.get(s, 0) for s in range(vocab)])]))
    files = Files(folder, vocab, shards, bases, sum(r.total for r in sizes))
    if not files.words:
        return files
    if files.words >= 1 << 32:
        raise ValueError("more than 2**32 words: pairs of ids don't fit in 64 bits")

    def count_bigrams(batches):
        words, held, n = Vocabulary(files), [], 0
        for part in _pieces(batches):
            k, c = _pairs(part.column(0), words)[:2]
            held.append((k, c))
            n += len(k)
            if n > GATHER:
                keys, counts = merge_counts(held)
                yield _emit(keys, counts, shards_of(keys, shards))
                held, n = [], 0
        if held:
            keys, counts = merge_counts(held)
            yield _emit(keys, counts, shards_of(keys, shards))

    def write_bigrams(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        keys, counts = merge_counts([unpack_counts(x) for x in t.column("counts").to_pylist()])
        ids, back = np.unique((keys >> np.uint64(32)).astype(np.int64), return_inverse=True)
        raw, contexts, own = Bigrams.build(keys, counts, _counts(files, ids)[back], files.words)
        common.write_file(f"{folder}/pairs-{shard}.ef", raw)
        s = np.searchsorted(np.array(files.bases), contexts, side="right") - 1
        return pa.table(_emit(contexts.astype(np.uint64), own, s).to_pydict(), schema=_blobs("counts"))

    def write_backoff(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        ids, kinds = merge_counts([unpack_counts(x) for x in t.column("counts").to_pylist()])
        ids = ids.astype(np.int64)
        out = np.zeros(files.bases[shard + 1] - files.bases[shard], np.uint8)  # a word that nothing follows backs off whole
        out[ids - files.bases[shard]] = quantise(np.log10(DISCOUNT * kinds / _counts(files, ids)))
        common.write_file(f"{folder}/backoff-{shard}.q", out.tobytes())
        return pa.table({"shard": [shard]})

    pairs = texts.mapInArrow(count_bigrams, "shard long, counts binary").groupBy("shard").applyInArrow(write_bigrams, "shard long, counts binary")
    wrote = {r.shard for r in pairs.groupBy("shard").applyInArrow(write_backoff, "shard long").collect()}
    for s in set(range(vocab)) - wrote:
        common.write_file(f"{folder}/backoff-{s}.q", bytes(bases[s + 1] - bases[s]))
    return files


def _counts(files: Files, ids: np.ndarray) -> np.ndarray:
    words, out = Vocabulary(files), np.zeros(len(ids), np.int64)
    s = np.searchsorted(np.array(files.bases), ids, side="right") - 1
    for k in np.unique(s).tolist():
        own = np.flatnonzero(s == k)
        out[own] = words.shard(k)[1][ids[own] - files.bases[k]].astype(np.int64)
    return out


def _pairs(texts: pa.Array, words: Vocabulary):
    """Distinct pairs of known words with counts; and of every token its text, id and count, and its pair's index (-1: none)."""
    of, h = tokens(texts)
    distinct, back = np.unique(h, return_inverse=True)
    ids, counts = words.find(distinct)
    ids, counts = ids[back], counts[back]
    follows = np.flatnonzero((of[1:] == of[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
    keys, index, c = np.unique((ids[follows - 1].astype(np.uint64) << np.uint64(32)) | ids[follows].astype(np.uint64), return_inverse=True, return_counts=True)
    pair = np.full(len(of), -1, np.int64)
    pair[follows] = index
    return keys, c, of, ids, counts, pair


class Scorer:
    def __init__(self, files: Files):
        self.files, self.words, self.pairs = files, Vocabulary(files), {}

    def shard(self, s: int) -> Bigrams | None:
        if s not in self.pairs:
            if len(self.pairs) >= MAPPED:
                del self.pairs[next(iter(self.pairs))]
            try:
                self.pairs[s] = Bigrams(common.mapped(f"{self.files.folder}/pairs-{s}.ef"))
            except FileNotFoundError:  # no pair fell to this shard
                self.pairs[s] = None
        return self.pairs[s]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score and the model's log10 probability.

        A token's probability is its pair's discounted one plus the context's back-off weight times its own, which is
        the base's; after an unknown word or at the start it is its own.
        """
        n, v = self.files.total, self.files.words
        keys, _, of, ids, counts, pair = _pairs(texts, self.words)
        alone = (counts + 1) / (n + v + 1)
        found = np.zeros(len(keys))
        s = shards_of(keys, self.files.bigrams)
        order = np.argsort(s, kind="stable")
        cuts = np.flatnonzero(np.diff(s[order], prepend=-1))
        for a, b in pairwise([*cuts.tolist(), len(s)]):
            if (level := self.shard(int(s[order[a]]))) is not None:
                own = order[a:b]
                found[own] = level.find((keys[own] >> np.uint64(32)).astype(np.int64), (keys[own] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        p = alone.copy()
        after = np.zeros(len(of), bool)
        after[1:] = (of[1:] == of[:-1]) & (ids[:-1] >= 0)
        at = np.flatnonzero(after)
        if len(at):
            contexts, back = np.unique(ids[at - 1], return_inverse=True)
            p[at] *= self.words.backoff(contexts)[back]
            p[at] += np.where(pair[at] >= 0, found[np.maximum(pair[at], 0)] if len(found) else 0, 0)
        size = len(texts)
        total = lambda x: np.bincount(of, weights=x, minlength=size)
        return np.bincount(of, minlength=size), total(counts > 0).astype(np.int64), total(np.log10(alone)), total(np.log10(np.minimum(p, 1)))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, files: Files) -> DataFrame:
    """Score every row's whole text (null: empty, an end alone) by itself. Without a training token all words are unknown."""

    def rows(batches):
        scorer = Scorer(files)
        for part in _pieces(batches):
            n, known, base, score = scorer.score(part.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(n), files.total), pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(7).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(rows, SCORED)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs, train(docs.where(~held_out(7))))
