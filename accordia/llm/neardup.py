"""Operator 6: near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles; two are linked if their weighted Jaccard similarity is at least
0.8, and a class is what links connect. Signatures are BagMinHash: each shingle has a Poisson process over time and
weight, the same in every document. The weight axis is cut into (0,1], (1,2], (2,4], (4,8] and so on, each with points
at a rate of its width; a point's bits descend the halves of its interval to a unit of weight, and the point counts if
the shingle's weight reaches that unit. A signature slot keeps the earliest point that falls to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix

WORDS = 5
#: Keys with more than one part in HOT of all rows are joined apart from the rest: there are never more than HOT of them, so these are broadcast.
HOT = 2000
#: Bits of the largest filter of row hashes (32 MB); beyond, it lets more rows through and the exact join decides.
FILTER_BITS = 1 << 28


@dataclass(frozen=True)
class Setup:
    """bands of `rows` slots: a pair at 0.8 shares no band with probability (1 - 0.8**rows)**bands, 3e-5 here. least:
    matching slots of a pair that goes to the exact check (five deviations below what 0.8 gives). early: bands of the
    first round, within blocks; block: documents and elements of a block at most, unless one document has more."""

    bands: int = 20
    rows: int = 4
    least: int = 46
    early: int = 3
    block: int = 800
    block_elements: int = 800_000

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document index, shingle hash) with counts, ordered by both. A text of one to four words is one shingle."""
    owner, code, words = common.split_words(texts, False)
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = common.hash_strings(words)[code]
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner]
    take = np.flatnonzero((place + WORDS <= n[owner]) | ((place == 0) & (n[owner] < WORDS)))
    s = np.zeros(len(take), np.uint64)
    wide = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        inside = place[take] + k < n[owner[take]]
        s = mix(s ^ np.where(inside, wide[take + k], np.uint64(k + 1)))
    d = owner[take]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(s, prepend=s[0] + np.uint64(1)) != 0))
    return d[new], s[new], np.diff(np.append(new, len(d)))


def signatures(d: np.ndarray, s: np.ndarray, c: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (docs, slots) as 32-bit values of weighted sets; those without elements stay zero."""
    weight = np.bincount(d, weights=c, minlength=docs)
    # the intervals of each element that its weight reaches into
    levels = np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(d)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    key = mix(s[of] + mix(level.astype(np.uint64)))
    sig = np.full(docs * slots, np.inf)
    limit = (np.log(slots) + 6) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        wanted = np.zeros(docs, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[d[of]])
        t = np.zeros(len(live))
        j = 0
        while len(live):
            u = (mix(key[live] + np.uint64(2 * j)) >> np.uint64(11)).astype(np.float64)
            t = t - np.log((u + 0.5) * 2.0**-53) / (slots * width[live])
            ok = t <= limit[d[of[live]]]
            live, t = live[ok], t[ok]
            r = mix(key[live] + np.uint64(2 * j + 1))
            unit = (r & np.uint64(0xFFFFFFFF)).astype(np.int64) % width[live]
            hit = low[live] + unit < c[of[live]]
            slot = (r[hit] >> np.uint64(32)).astype(np.int64) % slots
            np.minimum.at(sig, d[of[live[hit]]] * slots + slot, t[hit])
            j += 1
        # a slot is final once it is filled: every point up to the limit has been seen
        todo = todo[np.isinf(sig.reshape(docs, slots)[todo]).any(axis=1)]
        limit[todo] *= 2
    sig[np.isinf(sig)] = 0
    return (mix(sig.view(np.uint64)) >> np.uint64(32)).astype("<u4").reshape(docs, slots)


def elements(d: np.ndarray, s: np.ndarray, c: np.ndarray, docs: int) -> list[np.ndarray]:
    """Each document's multiset as a set: the hash of a shingle and its count so far, ascending."""
    of = np.repeat(np.arange(len(d)), c)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
    e, owner = mix(s[of] + mix(nth.astype(np.uint64))), d[of]
    e = e[np.lexsort((e, owner))]
    return np.split(e, np.cumsum(np.bincount(owner, minlength=docs))[:-1])


def keys(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits for each set: equal multisets, equal keys."""
    import hashlib

    return [hashlib.blake2b(e.astype("<u8").tobytes(), digest_size=16).digest() for e in sets]


def row_hashes(columns: list[Column]) -> list[Column]:
    """Two 64-bit hashes (w, w2) of a row by these columns, nulls told apart; equal rows have equal ones."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(*parts).alias("w"), F.xxhash64(F.lit(2), *reversed(parts)).alias("w2")]


def signed(docs: DataFrame, setup: Setup, by: list[Column]) -> DataFrame:
    """doc_id, w, w2, key, sig of each row. Null and empty texts have the empty multiset."""

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                d, s, c = shingles(part.column("text"))
                sig = signatures(d, s, c, part.num_rows, setup.slots)
                own = {n: part.column(n) for n in ("doc_id", "w", "w2")}
                yield pa.RecordBatch.from_pydict(own | {"key": pa.array(keys(elements(d, s, c, part.num_rows)), pa.binary()), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_hashes(by))
    return src.mapInArrow(rows, "doc_id long, w long, w2 long, key binary, sig binary")


def banded(reps: DataFrame, setup: Setup) -> DataFrame:
    """key, band, bucket: one row for each band of each distinct signature."""
    size = 4 * setup.rows
    buckets = F.transform(F.sequence(F.lit(0), F.lit(setup.bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("sig", b * size + 1, F.lit(size))).alias("bucket")))
    return reps.select("key", F.inline(buckets))


def joined(rows: DataFrame, info: DataFrame, by: list[str], total: int, n: str) -> DataFrame:
    """The rows (total in all) with the info of their key. info has each key once, with its number of rows as column n.

    Hot keys' rows stay where they are; a key of the others has at most one part in HOT of all rows.
    """
    most = max(64, total // HOT)
    heavy = info.where(F.col(n) > most).drop(n)
    there = rows.join(F.broadcast(heavy), by)
    rest = rows.join(F.broadcast(heavy.select(*by)), by, "left_anti").join(info.where(F.col(n) <= most).drop(n), by)
    return there.unionByName(rest)


def found_in(rows: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """Add hit, by a filter of the `count` wanted rows' hashes w: a row without it isn't wanted, one with it may be.

    The filter is a bitmap of 16 bits a wanted row, FILTER_BITS at most, made and read by the JVM.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * max(count, 1) - 1).bit_length()))
    place = F.pmod("w", F.lit(bits)) + 1
    maps = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket", "left").withColumn("hit", hit).drop("_bucket", "_bits")


def with_elements(docs: DataFrame, wanted: DataFrame, by: list[Column]) -> DataFrame:
    """key, elems of the wanted (key, w, w2): only rows that the filter lets through leave their place."""
    src = found_in(docs.select(F.col("text").cast("string").alias("text"), *row_hashes(by)), wanted, wanted.count()).where("hit")
    src = src.groupBy("w", "w2").agg(F.first("text").alias("text")).join(wanted, ["w", "w2"])

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                sets = elements(*shingles(part.column("text")), part.num_rows)
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "elems": pa.array([e.astype("<u8").tobytes() for e in sets], pa.binary())})

    return src.select("text", "key").mapInArrow(rows, "key binary, elems binary")


def linked(comp: list, sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links between left and right documents that join different components, enough to join all that should be."""
    names = {c: i for i, c in enumerate(dict.fromkeys(comp))}
    label = np.array([names[c] for c in comp])
    size = np.array([len(e) for e in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
    same = np.zeros((len(lefts), len(rights)), np.uint8)
    for k in range(sig.shape[1]):
        same += sig[lefts, k][:, None] == sig[rights, k][None, :]
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    out = []
    for row, i in enumerate(lefts.tolist()):
        js = rights[(same[row] >= least) & (label[rights] != label[i])]
        # the sizes alone bound the similarity
        js = js[10 * np.minimum(size[js], size[i]) >= 8 * np.maximum(size[js], size[i])]
        if not len(js) or not size[i]:
            continue
        own = flat[start[i] : start[i] + size[i]]
        mark[own] = True
        at = np.repeat(start[js] - (np.cumsum(size[js]) - size[js]), size[js]) + np.arange(size[js].sum())
        both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(size[js]) - size[js])
        mark[own] = False
        for j in js[10 * both >= 8 * (size[i] + size[js] - both)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def links(tasks: DataFrame, data: DataFrame, setup: Setup) -> DataFrame:
    """Verified links (a, b) from rows (task, key, comp, left, right); data has key, sig, elems. A task's rows are a bounded block."""

    def verify(t: pa.Table) -> pa.Table:
        key = t.column("key").to_pylist()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(len(key), -1)
        sets = [np.frombuffer(x, "<u8") for x in t.column("elems").to_pylist()]
        found = linked(t.column("comp").to_pylist(), sig, sets, np.asarray(t.column("left")), np.asarray(t.column("right")), setup.least)
        return pa.table({"a": pa.array([key[i] for i, _ in found], pa.binary()), "b": pa.array([key[j] for _, j in found], pa.binary())})

    return tasks.join(data, "key").select("task", "key", "comp", "left", "right", "sig", "elems").groupBy("task").applyInArrow(verify, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """key, comp (the least key of its component) by alternating large and small stars; rows stay in the cluster."""

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        if large:
            e, total = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * total
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        got = joined(e, least, ["a"], total, "n")
        if large:
            return got.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        pairs = got.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(got.select("a", F.col("m").alias("b")))
        return pairs.where(F.col("a") != F.col("b")).distinct()

    e = common.settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    was = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not now.n or now == was:
            return e.select(F.col("a").alias("key"), F.col("b").alias("comp"))
        was = now
        wide = common.settle(star(e, True, now.n), "edges")
        e = common.settle(star(wide, False, wide.count()), "edges")


def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def grouped(docs: DataFrame, setup: Setup, by: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, w, w2, key) and, for each key, n rows and its class: class_id, and rep, the row that stands for it."""
    rows = common.settle(signed(docs, setup, by), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "w", "w2"))
    reps = common.settle(rows.groupBy("key").agg(least.alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")), "reps")
    bands = banded(reps, setup)
    shared = common.settle(bands.groupBy("band", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    cand = common.settle(joined(bands, shared, ["band", "bucket"], total, "n"), "bands")
    wanted = common.settle(cand.select("key").distinct().join(reps, "key").select("key", "rep.w", "rep.w2"), "wanted")
    data = common.settle(with_elements(docs, wanted, by).join(reps.select("key", "sig"), "key").withColumn("size", F.length("elems") / 8), "elements")
    sized = common.settle(cand.join(data.select("key", "size"), "key"), "sized")
    # round one: blocks of a bucket, dealt anew for each band
    early = sized.where(F.col("band") < setup.early)
    heavy = early.groupBy("band", "bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("rows") / setup.block), F.ceil(F.col("weight") / setup.block_elements), F.lit(1)).cast("int")
    first = joined(early, common.settle(heavy.select("band", "bucket", "rows", blocks.alias("blocks")), "blocks"), ["band", "bucket"], total, "rows")
    first = first.select(F.struct("band", "bucket", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int").alias("i"), F.lit(0).alias("j")).alias("task"), "key", F.col("key").alias("comp"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    found = common.settle(links(first, data.drop("size"), setup), "links")
    comps = components(found)
    # round two: what is left between components
    now = common.settle(with_components(sized, comps), "sized")
    per = now.groupBy("band", "bucket", "comp").agg(F.count("*").alias("rows"), F.sum("size").alias("weight"))
    mixed = per.groupBy("band", "bucket").agg(F.count("*").alias("comps"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.max(F.struct("rows", "weight", "comp")).alias("top")).where(F.col("comps") > 1)
    deal = mixed.select(
        "band", "bucket", "rows", F.col("top.comp").alias("top"),
        F.greatest(F.ceil(F.col("rows") / setup.block), F.ceil(F.col("weight") / setup.block_elements), F.lit(1)).cast("int").alias("nj"),
        F.greatest(F.ceil((F.col("rows") - F.col("top.rows")) / setup.block), F.ceil((F.col("weight") - F.col("top.weight")) / setup.block_elements), F.lit(1)).cast("int").alias("ni"),
    )
    own = joined(now, common.settle(deal, "deal"), ["band", "bucket"], total, "rows").withColumn("h", F.xxhash64("key"))
    i, j = F.pmod("h", "ni").cast("int"), F.pmod("h", "nj").cast("int")
    as_right = own.select("*", j.alias("j"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    as_left = own.where(F.col("comp") != F.col("top")).select("*", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    both = as_right.unionByName(as_left).groupBy(F.struct("band", "bucket", "i", "j").alias("task"), "key", "comp").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    more = common.settle(links(both, data.drop("size"), setup), "links")
    final = comps
    if not more.isEmpty():
        final = components(found.unionByName(more))
    whole = common.settle(with_components(reps.select("key", "rep", "n"), final), "whole")
    ids = common.settle(whole.groupBy("comp").agg(F.min("rep").alias("rep"), F.count("*").alias("keys")), "classes")
    # of classes with the same least id, one is named by it
    owner = ids.where("rep.doc_id IS NOT NULL").groupBy(F.col("rep.doc_id").alias("class_id")).agg(F.min("comp").alias("comp"))
    name = F.coalesce("class_id", -1 - F.pmod(F.xxhash64("comp"), F.lit(1 << 62)))
    named = ids.join(owner, "comp", "left").select("comp", "keys", "rep", name.alias("class_id"))
    return rows.drop("sig"), common.settle(joined(whole.drop("rep"), common.settle(named, "named"), ["comp"], whole.count(), "keys"), "keys")


def classes(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, class_id for every row of docs; class_id is the least doc_id of its class.

    A class without an id, and each but one of several classes with the same least id, has a negative number made from
    its texts instead, so that no two classes share a name. Documents of the same shingles are one vertex from the
    start, so that thousands of copies cost as much as one. Those without words are copies of each other. Rows that
    share an id, or have none, are placed each by its text. Round one looks within blocks of a bucket for a few bands; round two compares,
    in every bucket of every band that still has several components, all of them with each other, except for the
    largest with itself. Blocks bound what a task holds, and no join deals a hot bucket, component or text to one task.
    An empty table gives no rows; other columns aren't read.
    """
    rows, keys = grouped(docs, setup, [F.col("doc_id"), F.col("text")])
    return joined(rows.select("doc_id", "key"), keys.select("key", "n", "class_id"), ["key"], rows.count(), "n").select("doc_id", "class_id")


def filter_documents(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """The rows of docs, with their columns, that represent their class: one row of each, of the least id (rows without
    one come last, and of rows with the same id the one with the least hash).

    Rows that are equal in all columns are one. Rows that stay don't leave their place, but for those that the filter of
    row hashes takes for one that goes. An empty table gives no rows.
    """
    by = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    rows, keys = grouped(docs, setup, by)
    named = keys.select("key", "n", F.col("rep.w").alias("rw"), F.col("rep.w2").alias("rw2"))
    stays = (F.col("w") == F.col("rw")) & (F.col("w2") == F.col("rw2"))
    placed = common.settle(joined(rows.select("key", "w", "w2"), named, ["key"], rows.count(), "n").groupBy("w", "w2").agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "placed")
    # rows that go, and rows that occur more than once
    doubtful = placed.where("NOT stays OR n > 1")
    src = found_in(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), *row_hashes(by)), doubtful, doubtful.count())
    seen = src.where("hit").groupBy("w", "w2").agg(F.first("row").alias("row")).join(placed.where("NOT stays").select("w", "w2"), ["w", "w2"], "left_anti")
    return src.where("NOT hit").select("row.*").unionByName(seen.select("row.*"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))
