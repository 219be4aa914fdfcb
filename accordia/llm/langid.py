"""Operator 2: language identification by a bidirectional gated recurrent network over bytes.

A cell of each direction reads a window of bytes; every position gets class probabilities from both states, and a
document's are their mean over the positions of letters in all its windows. Trained here in numpy, by backpropagation
through time, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


@dataclass(frozen=True)
class Setup:
    """per_language: labelled rows in the sample for each language, in expectation; span: bytes of a training window;
    window: bytes of a window that is labelled; batch: windows at a time."""

    per_language: int = 600
    span: int = 96
    hidden: int = 16
    steps: int = 350
    rows: int = 96
    rate: float = 0.02
    window: int = 256
    batch: int = 1024


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _step(u: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of a gated cell: gates z and r, candidate n, the recurrent part q of n. e is used up, h is not changed."""
    k = len(h)
    a = u @ h
    gates = e[: 2 * k]
    gates += a[: 2 * k]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    z, r, q = gates[:k], gates[k:], a[2 * k :]
    n = r * q
    n += e[2 * k :]
    np.tanh(n, out=n)
    return z, r, n, q


def _score(u: np.ndarray, e: np.ndarray, o: np.ndarray, x: np.ndarray, active: np.ndarray, out: np.ndarray, backward: bool) -> None:
    """Add to out (steps, classes, windows) the scores by one cell's states after each byte of x (steps, windows). At step t
    the first active[t] windows have a byte. A window is a row, so that a byte's weights are copied as a whole."""
    k = u.shape[1]
    # a gate is (1 + tanh(v / 2)) / 2, and halves are exact
    uz, ur, un = (np.ascontiguousarray(0.5 * u[i : i + k].T) for i in (0, k, 2 * k))
    ez, er, en = (np.ascontiguousarray(c * e[i : i + k].T) for i, c in ((0, 0.5), (k, 0.5), (2 * k, 1.0)))
    states = np.zeros((x.shape[1], k), u.dtype)
    for t in range(len(x) - 1, -1, -1) if backward else range(len(x)):
        m = active[t]
        h, byte = states[:m], x[t, :m].astype(np.intp)
        z, r, n = h @ uz, h @ ur, h @ un
        z += ez.take(byte, 0)
        np.tanh(z, out=z)
        r += er.take(byte, 0)
        np.tanh(r, out=r)
        r += 1
        n *= r
        n += en.take(byte, 0)
        np.tanh(n, out=n)
        z += 1
        h -= n
        h *= z
        h *= 0.5
        h += n
        out[t, :, :m] += o @ h.T


def _windows(raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of each window its document, start and length."""
    n = np.array([len(r) for r in raws], np.int64)
    k = -(-n // size)
    of = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    start = np.repeat(np.cumsum(n) - n, k) + nth * size
    return np.frombuffer(b"".join(raws), np.uint8), of, start, np.minimum(size, n[of] - nth * size)


def positions(model: Model, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Class probabilities (steps, classes, windows) of every position of windows given by descending length."""
    w, steps = model.weights, int(length[0])
    at = np.arange(steps)
    active = np.searchsorted(-length, -at, side="left")  # windows longer than t
    x = np.ascontiguousarray(flat[np.minimum(start[:, None] + at, len(flat) - 1)].T)
    out = np.empty((steps, len(w["bias"]), len(length)), np.float32)
    out[:] = w["bias"][:, None]
    for d in ("f", "b"):
        _score(w["u" + d], w["e" + d], w["o" + d], x, active, out, d == "b")
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def predict(model: Model, texts: list[str | None], setup: Setup = Setup()) -> list[tuple[str, float]]:
    """Language and its pooled probability for each whole text. Null, or no letter, or a model without languages: und, 0.
    Of equally likely languages, the first of model.languages."""
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    lettered = [any(map(str.isalpha, t or "")) for t in texts]
    raws = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, lettered, strict=True)]
    flat, of, start, length = _windows(raws, setup.window)
    order = np.argsort(-length, kind="stable")
    pooled, weight = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for a in range(0, len(order), setup.batch):
        own = order[a : a + setup.batch]
        p = positions(model, flat, start[own], length[own])
        at = np.arange(len(p))[:, None]
        letter = (at < length[own]) & LETTER[flat[np.minimum(start[own] + at, len(flat) - 1)]]
        sums = np.einsum("tcb,tb->bc", p, letter.astype(np.float32))
        np.add.at(pooled, of[own], sums)
        np.add.at(weight, of[own], letter.sum(axis=0))
    best = pooled.argmax(axis=1)
    score = np.clip(pooled[np.arange(len(texts)), best] / np.maximum(weight, 1), 0, 1)
    return [(model.languages[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best.tolist(), score.tolist(), lettered, strict=True)]


def train(samples: list[tuple[str, bytes]], setup: Setup = Setup()) -> Model:
    """Fit the network to (language, bytes) windows. Without samples, a model without languages."""
    languages = sorted({s for s, _ in samples})
    if not languages:
        return Model()
    rng = np.random.default_rng(7)
    k, c, steps = setup.hidden, len(languages), setup.span
    samples = [(s, raw) for s, raw in samples if raw]
    data = np.array([np.resize(np.frombuffer(raw + b" ", np.uint8), steps) for _, raw in samples], np.uint8).reshape(-1, steps)
    truth = np.array([languages.index(s) for s, _ in samples], np.int64)
    by = [np.flatnonzero(truth == i) for i in range(c)]
    by = [b for b in by if len(b)]
    w = {n: (rng.normal(size=(3 * k, k)) / np.sqrt(k)).astype(np.float32) for n in ("uf", "ub")}
    w |= {n: (rng.normal(size=(3 * k, 256)) * 0.3).astype(np.float32) for n in ("ef", "eb")}
    w |= {n: (rng.normal(size=(c, k)) / np.sqrt(k)).astype(np.float32) for n in ("of", "ob")}
    w["bias"] = np.zeros(c, np.float32)
    first, second = {n: np.zeros_like(v) for n, v in w.items()}, {n: np.zeros_like(v) for n, v in w.items()}
    for step in range(setup.steps if by else 0):
        rows = np.concatenate([rng.choice(b, -(-setup.rows // len(by))) for b in by])
        grad = _gradient(w, np.ascontiguousarray(data[rows].T), truth[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = setup.rate * (1 - step / setup.steps)
        for n, g in grad.items():
            g = g * scale
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            w[n] -= rate * (first[n] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[n] / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Model(languages, w)


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over the positions of letters, by backpropagation through time. x: (steps, rows)."""
    steps, rows = x.shape
    k = w["uf"].shape[1]
    kept, states = {}, {}
    for d, xs in (("f", x), ("b", x[::-1])):
        h = np.zeros((k, rows), np.float32)
        kept[d], states[d] = [], np.empty((steps, k, rows), np.float32)
        for t in range(steps):
            z, r, n, q = _step(w["u" + d], np.take(w["e" + d], xs[t], axis=1), h)
            kept[d].append((h, z, r, n, q))
            h = n + z * (h - n)
            states[d][t] = h
    logits = np.matmul(w["of"], states["f"]) + np.matmul(w["ob"], states["b"])[::-1] + w["bias"][:, None]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[:, truth, np.arange(rows)] -= 1
    letter = LETTER[x].astype(np.float32)
    p *= (letter / max(1.0, float(letter.sum())))[:, None, :]
    grad = {"bias": p.sum(axis=(0, 2))}
    for d, dp in (("f", p), ("b", p[::-1])):
        u = w["u" + d]
        grad["o" + d] = np.einsum("tcb,tkb->ck", dp, states[d])
        dstate = np.matmul(w["o" + d].T, dp)
        du, de = np.zeros_like(u), np.empty((steps, 3 * k, rows), np.float32)
        dh = np.zeros((k, rows), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, q = kept[d][t]
            dh = dh + dstate[t]
            dn = dh * (1 - z) * (1 - n * n)
            da = np.concatenate([dh * (h - n) * z * (1 - z), dn * q * r * (1 - r), dn * r])
            de[t] = da
            de[t, 2 * k :] = dn
            du += da @ h.T
            dh = dh * z + u.T @ da
        grad["u" + d] = du
        table = np.zeros((256, 3 * k), np.float32)
        np.add.at(table, (x if d == "f" else x[::-1]).reshape(-1), de.transpose(0, 2, 1).reshape(-1, 3 * k))
        grad["e" + d] = table.T.copy()
    return grad


def held_out(parts: int = 4, rest: int = 2):
    """Whether crc32 of doc_id as text has that remainder; a null id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


def fit(docs: DataFrame, setup: Setup = Setup()) -> Model:
    """Train on rows that aren't held out, with a text and a language: about per_language of each, picked by a hash.

    One window of each picked text reaches the driver, from a place that a hash picks; rows with a null id are left out.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    share = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(min(1.0, setup.per_language / n)))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - setup.span, F.lit(1))).cast("int") + 1
    got = picked.select("lang", "doc_id", F.substring("text", place, F.lit(setup.span)).alias("part")).collect()
    return train([(r.lang, r.part.encode("utf-8", "replace")[: setup.span]) for r in sorted(got, key=lambda r: (r.lang, r.doc_id, r.part))], setup)


def identify(docs: DataFrame, model: Model, setup: Setup = Setup()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its whole text alone.

    Null and empty texts, and those without a letter, are "und" at 0, as all are by a model without languages. Of
    languages that are equally likely the first by name is taken. Repeated rows and rows without an id are labelled each
    (a null id isn't held out); very long texts are labelled window by window; an empty table gives no rows; other
    columns aren't read."""

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                got = predict(model, part.column("text").to_pylist(), setup)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array([a for a, _ in got], pa.string()), "score": pa.array([b for _, b in got], pa.float64())})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def filter_documents(docs: DataFrame, least: float = 0.4, setup: Setup = Setup()) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known at that score at least: null texts, empty ones
    and those without a letter go, repeated rows stay or go together, and an empty table gives no rows. The model is
    trained on docs' own labelled rows; where there are none, no language is known and all rows go."""
    model = fit(docs, setup)

    def keep(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                yield part.filter(pa.array([a != UNKNOWN and b >= least for a, b in predict(model, part.column("text").to_pylist(), setup)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
