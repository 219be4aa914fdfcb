"""Token ids as patched frame-of-reference blocks in binary files.

A file: magic, counts of ids, blocks and documents, the blocks' starts, the blocks, the documents' ids and lengths.
A block of 128 ids: their minimum, a bit width, the count of exceptions; each id less the minimum, its low bits packed
at the width; the exceptions' places and high bits. The width is the least that holds the percentile asked for.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
MAGIC = b"PFB1"
HEAD = struct.Struct("<4sQII")
#: min u32, width u8, exceptions u8
PREFIX = 6


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of integers below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of 128 values below 2**w as rows of 16*w bytes."""
    words = np.zeros((len(v), 2 * w), np.uint64)
    v = v.astype(np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * w, 64)
        words[:, at] |= v[:, i] << np.uint64(shift)
        if shift + w > 64:
            words[:, at + 1] |= v[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").view(np.uint8)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(raw).view("<u8")
    out = np.empty((len(raw), BLOCK), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * w, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + w > 64:
            x = x | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, i] = x & mask
    return out


def encode_blocks(ids: np.ndarray, percentile: float = 90) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks, one more for the end, and their bytes. The last block is filled up with its last id."""
    nb = -(-len(ids) // BLOCK)
    if not nb:
        return np.zeros(1, "<u8"), np.zeros(0, np.uint8)
    v = np.concatenate([ids, np.repeat(ids[-1:], nb * BLOCK - len(ids))]).astype(np.uint32).reshape(nb, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    k = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    width = _bits(np.partition(v, k, axis=1)[:, k])
    over = (v.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    n_exc = over.sum(axis=1)
    size = PREFIX + 16 * width + 5 * n_exc
    starts = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    out = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1].astype(np.int64)
    out[at[:, None] + np.arange(4)] = low.astype("<u4")[:, None].view(np.uint8)
    out[at + 4] = width
    out[at + 5] = n_exc
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        out[(at[own] + PREFIX)[:, None] + np.arange(16 * w)] = _pack(v[own] & np.uint32((1 << w) - 1), w)
    b, pos = np.nonzero(over)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        to = at[b] + PREFIX + 16 * width[b] + 5 * nth
        out[to] = pos
        high = (v[b, pos].astype(np.uint64) >> width[b].astype(np.uint64)).astype("<u4")
        out[to[:, None] + np.arange(1, 5)] = high[:, None].view(np.uint8)
    return starts, out


def decode_blocks(starts: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n ids of consecutive blocks; starts as from encode_blocks."""
    at = starts[:-1].astype(np.int64)
    if not len(at):
        return np.zeros(0, "<u4")
    low = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
    width, n_exc = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    v = np.zeros((len(at), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        v[own] = _unpack(raw[(at[own] + PREFIX)[:, None] + np.arange(16 * w)], w)
    b = np.repeat(np.arange(len(at)), n_exc)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        of = at[b] + PREFIX + 16 * width[b] + 5 * nth
        high = np.ascontiguousarray(raw[of[:, None] + np.arange(1, 5)]).view("<u4")[:, 0]
        v[b, raw[of]] |= high.astype(np.uint64) << width[b].astype(np.uint64)
    return (v + low[:, None]).astype("<u4").reshape(-1)[:n]


def pack_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, percentile: float = 90) -> bytes:
    """A whole file. lengths: ids of each document, which follow one another in ids; doc_ids may be null."""
    starts, blocks = encode_blocks(ids, percentile)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(ids), len(starts) - 1, len(doc_ids)), starts.tobytes(), blocks.tobytes(), keys.tobytes(), known.tobytes(), lengths.astype("<u8").tobytes()])


def unpack_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """What pack_file got."""
    magic, n, nb, docs = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of token-id blocks")
    raw = np.frombuffer(data, np.uint8)
    at = HEAD.size
    starts = np.frombuffer(data, "<u8", nb + 1, at)
    at += 8 * (nb + 1)
    ids = decode_blocks(starts, raw[at : at + int(starts[-1])], n)
    at += int(starts[-1])
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    return ids, [k if ok else None for k, ok in zip(keys, known.tolist(), strict=True)], lengths


def slice_ids(data: np.ndarray, start: int, length: int) -> np.ndarray:
    """Ids start to start+length of a file's bytes (memory-mapped, say), by its index of block starts."""
    _, n, nb, _ = HEAD.unpack(bytes(data[: HEAD.size]))
    start, end = min(start, n), min(start + length, n)
    if start >= end:
        return np.zeros(0, "<u4")
    a, b = start // BLOCK, -(-end // BLOCK)
    starts = np.frombuffer(bytes(data[HEAD.size + 8 * a : HEAD.size + 8 * (b + 1)]), "<u8")
    top = HEAD.size + 8 * (nb + 1)
    raw = np.array(data[top + int(starts[0]) : top + int(starts[-1])])
    return decode_blocks(starts - starts[0], raw, (b - a) * BLOCK)[start - a * BLOCK : end - a * BLOCK]
