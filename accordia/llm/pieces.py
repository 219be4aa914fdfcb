"""Operator 3: SentencePiece encoding and decoding with the N best segmentations.

The pieces that match a text form a lattice. A forward Viterbi pass gives every node the least cost of reaching it
from the start; with these as heuristics, which are exact, an A-star search runs backward from the end and takes whole
segmentations off its queue in order of cost. No piece crosses the start of a run of spaces or a character that no
piece holds, so the lattice of a text is a chain of small ones; a text's N best are found among those of its N-1
parts whose second best costs least more. The forward passes of all new parts of a batch run side by side in arrays.

Model files of merge pieces give ranks, not probabilities. By Zipf's law a piece of rank r costs round(1000 ln(r+2)):
integers, so that sums and ties are exact. A character without a piece is spelled in byte pieces, each at the cost of
a rank ten times the last.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from functools import cache
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL, N_BEST = "piece_bpe_32k.model", 4
#: Parts remembered by a worker at most; then the memo starts anew. Longer parts than LONG aren't remembered.
MEMO, LONG = 500_000, 64
SPACE = "▁"
#: The slack of a part that has one segmentation only.
NONE = 1 << 59
#: Characters by which the arcs from a place are remembered.
AHEAD = 4

Part = tuple[int, int, bytes]


class Pieces:
    """A piece model. A text's space is the model's space mark, and its own such marks are spelled in bytes, so
    decode(encode(text)) is the text, whatever it holds."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.spelling: list[bytes] = [b""] * n
        self.byte: dict[int, int] = {}
        self.cost: dict[str, tuple[int, int]] = {}
        last = max(-sp.get_score(i) for i in range(n) if -1e8 < sp.get_score(i))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace(SPACE, " ")
                rank = min(-sp.get_score(i), last)
                self.cost[text] = (i, round(1000 * math.log(max(rank, 0) + 2)))
                self.spelling[i] = text.encode()
        self.spell = round(1000 * math.log(10 * last + 2))
        #: Every piece with its id and cost, and every other beginning of a piece with None.
        self.table: dict[str, tuple[int, int] | None] = {p[:k]: None for p in self.cost for k in range(1, len(p))} | self.cost
        self.inner = {p[k : k + 2] for p in self.cost for k in range(len(p) - 1)}
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.alone = alone = "".join(c for c in "\n\t" if not any(c in p for p in self.cost))
        self.build_trie()
        self.size = np.array([len(x) for x in self.spelling], np.int64)
        self.spelled = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.parts = re.compile(f" +[^ {alone}]*|[{alone}]|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+").findall
        self.starts: dict[str, tuple[tuple[tuple[int, int], ...], bool]] = {}
        self.memo: dict[str, Part] = {}
        self.lists: dict[str, list[tuple[int, bytes]]] = {}

    def arcs(self, s: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end: (start, cost, ids), earliest start first."""
        out: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(s) + 1)]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if (p := s[a:b]) not in self.table:
                    break
                if got := self.table[p]:
                    out[b].append((a, got[1], (got[0],)))
            if s[a] not in self.cost:
                raw = s[a].encode("utf-8", "surrogatepass")
                out[a + 1].append((a, self.spell * len(raw), tuple(self.byte[x] for x in raw)))
        return out

    def forward(self, s: str) -> tuple[list[int], list[int], list[int]]:
        """Least cost of each node, where the last arc there starts, and how much the second cheapest way there costs."""
        n, far, starts = len(s), 1 << 60, self.starts
        least, second, back = [far] * (n + 1), [far] * (n + 1), [0] * (n + 1)
        least[0] = 0
        for a in range(n):
            f = least[a]
            got = starts.get(s[a : a + AHEAD]) or self.start(s[a : a + AHEAD])
            for size, c in got[0]:
                c += f
                b = a + size
                if c < least[b]:
                    second[b] = least[b]
                    least[b] = c
                    back[b] = a
                elif c < second[b]:
                    second[b] = c
            if got[1]:
                b = a + AHEAD + 1
                while b <= n and (x := self.table.get(s[a:b], 0)) != 0:
                    if x:
                        c = f + x[1]
                        if c < least[b]:
                            second[b], least[b], back[b] = least[b], c, a
                        elif c < second[b]:
                            second[b] = c
                    b += 1
        return least, back, second

    def start(self, s: str) -> tuple[tuple[tuple[int, int], ...], bool]:
        """Lengths and costs of the arcs that start with these characters, and whether a longer piece may."""
        out = [] if s[0] in self.cost else [(1, self.spell * len(s[0].encode("utf-8", "surrogatepass")))]
        k = 1
        while k <= len(s) and s[:k] in self.table:
            if got := self.table[s[:k]]:
                out.append((k, got[1]))
            k += 1
        if len(self.starts) >= MEMO // 4:
            self.starts.clear()
        self.starts[s] = tuple(out), k > AHEAD
        return self.starts[s]

    def build_trie(self) -> None:
        """Pieces as a trie in arrays: a node's child by a character is found by binary search of (node, character)."""
        node = {"": 0} | {p: k for k, p in enumerate(self.table, 1)}
        keys = np.array([(node[p[:-1]] << 21) | ord(p[-1]) for p in self.table], np.int64)
        order = np.argsort(keys)
        self.edges, self.children = keys[order], np.arange(1, len(node), dtype=np.int64)[order]
        self.piece_id, self.piece_cost = np.full(len(node), -1, np.int64), np.zeros(len(node), np.int64)
        for p, got in self.table.items():
            if got:
                self.piece_id[node[p]], self.piece_cost[node[p]] = got

    def bulk(self, parts: list[str]) -> list[Part]:
        """What best() gives for each part, by forward passes side by side: step k takes the arcs that start at place k."""
        size = np.array([len(s) for s in parts], np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        top = np.cumsum(size + 1) - size - 1  # each part's first node
        own = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        left = size[own] - place
        # all arcs: walk the trie from every place
        live, state, found, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), [], 0
        while len(live):
            key = (state << 21) | chars[live + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[at] == key
            live, state, depth = live[ok], self.children[at[ok]], depth + 1
            hit = self.piece_id[state] >= 0
            found.append((live[hit], np.full(int(hit.sum()), depth), self.piece_id[state[hit]], self.piece_cost[state[hit]]))
            more = left[live] > depth
            live, state = live[more], state[more]
        alone = np.zeros(len(chars), bool)
        alone[found[0][0]] = True
        odd = np.flatnonzero(~alone)
        utf8 = 1 + (chars[odd] >= 0x80) + (chars[odd] >= 0x800) + (chars[odd] >= 0x10000)
        found.append((odd, np.ones(len(odd), np.int64), -1 - chars[odd], self.spell * utf8))
        start, length, piece, cost = (np.concatenate([f[k] for f in found]) for k in range(4))
        order = np.argsort(place[start] * 1024 + length, kind="stable")
        start, length, piece, cost = start[order], length[order], piece[order], cost[order]
        step = place[start] * 1024 + length
        a = top[own[start]] + place[start]
        far = 1 << 60
        least, second = np.full(len(chars) + len(parts), far), np.full(len(chars) + len(parts), far)
        back, name = np.zeros(len(least), np.int64), np.zeros(len(least), np.int64)
        least[top] = 0
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for i, j in zip(cuts, cuts[1:], strict=False):  # one start and length: no two arcs end at the same node
            if i == j:
                continue
            x, y = a[i:j], a[i:j] + length[i:j]
            c, was = least[x] + cost[i:j], least[y]
            better = c < was
            second[y] = np.where(better, was, np.minimum(second[y], c))
            least[y] = np.where(better, c, was)
            back[y] = np.where(better, x, back[y])
            name[y] = np.where(better, piece[i:j], name[y])
        # back from the ends
        node, who, slack = top + size, np.arange(len(parts)), np.full(len(parts), far)
        steps = []
        while len(who):
            slack[who] = np.minimum(slack[who], second[node] - least[node])
            steps.append((who, name[node]))
            node = back[node]
            on = node > top[who]
            node, who = node[on], who[on]
        slack = np.minimum(slack, NONE)
        who = np.concatenate([w for w, _ in steps[::-1]])
        ids = np.concatenate([i for _, i in steps[::-1]])
        ids = ids[np.argsort(who, kind="stable")]
        count = np.bincount(who, minlength=len(parts))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        out = list(zip(least[top + size].tolist(), slack.tolist(), [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        begin = np.cumsum(count) - count
        for k in np.unique(np.repeat(np.arange(len(parts)), count)[ids < 0]).tolist():  # characters spelled in bytes
            spelled = [self.packed[i] if i >= 0 else b"".join([self.packed[self.byte[x]] for x in chr(-1 - i).encode("utf-8", "surrogatepass")]) for i in ids[begin[k] : begin[k] + count[k]].tolist()]
            out[k] = (*out[k][:2], b"".join(spelled))
        return out

    def best(self, s: str) -> Part:
        """Cost and ids of the cheapest segmentation of a part, and how much more the second costs."""
        subs = self.cut(s)
        if len(subs) > 1:
            known = [self.known(x) for x in subs]
            return sum([k[0] for k in known]), min([k[1] for k in known]), b"".join([k[2] for k in known])
        least, back, second = self.forward(s)
        b, more, ids = len(s), 1 << 60, []
        while b:
            if (x := second[b] - least[b]) < more:
                more = x
            a = back[b]
            got = self.cost.get(s[a:b])
            ids.append(self.packed[got[0]] if got else b"".join([self.packed[self.byte[x]] for x in s[a:b].encode("utf-8", "surrogatepass")]))
            b = a
        ids.reverse()
        return least[-1], (more if more < NONE else NONE), b"".join(ids)

    def cut(self, s: str) -> list[str]:
        """The part between the places where no piece holds both characters."""
        inner = self.inner
        cuts = [k for k in range(1, len(s)) if s[k - 1 : k + 1] not in inner]
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]

    def known(self, s: str) -> Part:
        if (k := self.memo.get(s)) is None:
            k = self.best(s)
            if len(s) <= LONG:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[s] = k
        return k

    def all_known(self, parts: list[str]) -> list[Part]:
        """known() of distinct parts; the new ones, and what new long ones are cut into, are found side by side."""
        out = list(map(self.memo.get, parts))
        new = {s for s, k in zip(parts, out, strict=True) if k is None}
        if not new:
            return out
        short = [s for s in new if len(s) <= LONG]
        subs = {x for s in new if len(s) > LONG for x in self.cut(s) if len(x) <= LONG}
        if len(self.memo) + len(short) + len(subs) > MEMO:
            self.memo.clear()
        short += subs.difference(self.memo).difference(short)
        for a in range(0, len(short), 20_000):
            run = short[a : a + 20_000]
            self.memo.update(zip(run, self.bulk(run), strict=True))
        return [k if k is not None else self.known(s) for s, k in zip(parts, out, strict=True)]

    def n_best(self, s: str, n: int) -> list[tuple[int, bytes]]:
        """The n cheapest segmentations, by A-star from the end with the forward costs; fewer if there aren't as many."""
        least, arcs = self.forward(s)[0], self.arcs(s)
        queue: list[tuple[int, int, int, int, tuple]] = [(least[-1], 0, len(s), 0, ())]
        made, out = 0, []
        while queue and len(out) < n:
            total, _, node, tail, ids = heapq.heappop(queue)
            if not node:
                flat = []
                while ids:
                    flat += ids[0]
                    ids = ids[1]
                out.append((total, np.array(flat, "<u4").tobytes()))
                continue
            for a, c, i in arcs[node]:
                made -= 1  # of equal costs the latest goes first, so that a path is finished before others start
                heapq.heappush(queue, (least[a] + c + tail, made, a, tail + c, (i, ids)))
        return out

    def text_n_best(self, text: str | None, n: int) -> list[tuple[int, bytes]]:
        """The n cheapest segmentations of a whole text as (cost, ids); null counts as empty, which has one, of no piece."""
        if not text:
            return [(0, b"")]
        parts = self.parts(" " + text)
        known = self.all_known(parts)
        ends = np.cumsum([len(k[2]) for k in known])
        return self.ways(parts, np.array([k[1] for k in known]), ends, sum([k[0] for k in known]), b"".join([k[2] for k in known]), n)

    def ways(self, parts, more: np.ndarray, ends: np.ndarray, total: int, ids: bytes, n: int) -> list[tuple[int, bytes]]:
        """The n cheapest of a text from its cheapest one's cost and ids, and its parts' slacks and ends in the ids' bytes.
        parts[i] is the i-th part."""
        if n < 2:
            return [(total, ids)]
        # the n-1 parts of least slack, the earlier first of those that have the same
        weak = np.arange(len(more)) if len(more) < n else np.flatnonzero(more <= np.partition(more, n - 2)[n - 2])
        weak = weak[np.argsort(more[weak], kind="stable")][: n - 1].tolist()
        lists = [self.part_list(parts[i], n) for i in weak]
        above = [[x[0] - own[0][0] for x in own] + [NONE] * (n - len(own)) for own in lists]
        ways = sorted([(total + sum([x[c] for x, c in zip(above, pick, strict=True)]), pick) for pick in picks(len(lists), n)])[:n]
        ways = [w for w in ways if w[0] < NONE]
        out = [(total, ids)]
        for cost, pick in ways[1:]:
            now, at = [], 0
            for i, x, c in sorted(zip(weak, lists, pick, strict=True), key=lambda z: z[0]):
                if c:
                    now += [ids[at : int(ends[i - 1]) if i else 0], x[c][1]]
                    at = int(ends[i])
            out.append((cost, b"".join([*now, ids[at:]])))
        return out

    def part_list(self, s: str, n: int) -> list[tuple[int, bytes]]:
        if (got := self.lists.get(s)) is None:
            got = self.n_best(s, n)
            # the cheapest is the forward pass's, where several cost the same
            first = self.known(s)
            got = [(first[0], first[2]), *[x for x in got if x[1] != first[2]]][:n]
            if len(s) <= LONG:
                if len(self.lists) >= MEMO // 10:
                    self.lists.clear()
                self.lists[s] = got
        return got

    def decode(self, ids: bytes) -> str:
        """The text of ids that text_n_best gave."""
        return b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")[1:]


@cache
def picks(lists: int, n: int) -> list[tuple[int, ...]]:
    """Places in sorted lists that can be among the n least sums: all combinations of no later places come before."""
    return [pick for pick in product(range(n), repeat=lists) if math.prod(c + 1 for c in pick) <= n]


class Named:
    """The parts of a text by their codes."""

    def __init__(self, distinct: list[str], codes: np.ndarray):
        self.distinct, self.codes = distinct, codes

    def __getitem__(self, i: int) -> str:
        return self.distinct[self.codes[i]]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker and file. path: a file's path, or a name that public_tokenizers knows."""
    if path not in _loaded:
        _loaded[path] = Pieces(path if "/" in path else str(public_tokenizers.path(path)))
    return _loaded[path]


ENCODED = "doc_id long, n_tokens long, cost long, ids binary, nbest_costs array<long>, nbest_crc32 array<long>, decoded boolean"


def part_starts(p: Pieces, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin: at a run of spaces, at a character that stands alone, and after one. first: where texts do."""
    space, alone = raw == 32, np.isin(raw, list(p.alone.encode()))
    edge = alone.copy()
    edge[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
    edge[first] = True
    return np.flatnonzero(edge)


def encoded(p: Pieces, batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """A batch's rows of ENCODED."""
    raw, at = common.text_bytes(batch.column("text"))
    full = np.flatnonzero(np.diff(at) > 0)
    # a space before every text that isn't empty
    raw, at = np.insert(raw, at[full], 32), at + np.searchsorted(full, np.arange(len(at)))
    starts = part_starts(p, raw, at[full])
    codes, distinct = common.spans(raw, np.append(starts, len(raw)))
    known = p.all_known(distinct)
    sizes = np.array([len(k[2]) // 4 for k in known], np.int64)[codes] if known else np.zeros(0, np.int64)
    slack = np.array([k[1] for k in known], np.int64)[codes] if known else sizes
    costs = np.append(0, np.cumsum(np.array([k[0] for k in known], np.int64)[codes])) if known else np.zeros(1, np.int64)
    own = np.array([len(k[2]) // 4 for k in known], np.int64)
    flat = common.gather(np.frombuffer(b"".join([k[2] for k in known]), "<u4"), (np.cumsum(own) - own)[codes] if known else sizes, sizes)
    ends = np.append(0, np.cumsum(sizes))
    part = np.searchsorted(starts, at)  # each text's first part
    ids = flat.tobytes()
    got = []
    for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):
        if a == b:
            got.append([(0, b"")])
        else:
            got.append(p.ways(Named(distinct, codes[a:b]), slack[a:b], 4 * (ends[a + 1 : b + 1] - ends[a]), int(costs[b] - costs[a]), ids[4 * int(ends[a]) : 4 * int(ends[b])], n))
    # decode all ids at once; every text must come out where it lay
    letters = common.gather(p.spelled, (np.cumsum(p.size) - p.size)[flat], p.size[flat])
    length = np.append(0, np.cumsum(p.size[flat]))[ends[part]]
    if len(letters) == len(raw) and (length == at).all() and (letters == raw).all():
        decoded = np.ones(len(got), bool)
    else:
        decoded = np.array([letters[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(length[:-1], length[1:], at[:-1], at[1:], strict=True)], bool)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(g[0][1]) // 4 for g in got], pa.int64()),
            "cost": pa.array([g[0][0] for g in got], pa.int64()),
            "ids": pa.array([g[0][1] for g in got], pa.binary()),
            "nbest_costs": pa.array([[c for c, _ in g] for g in got], pa.list_(pa.int64())),
            "nbest_crc32": pa.array([[zlib.crc32(x) for _, x in g] for g in got], pa.list_(pa.int64())),
            "decoded": pa.array(decoded),
        }
    )


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """For every whole text (null: empty) the cheapest ids, and the costs and checksums of the n cheapest segmentations,
    cheapest first; decoded: whether the cheapest decodes to the text. Of segmentations that cost the same, which
    comes first depends only on the text. Repeated rows and rows without an id are encoded each; an empty table gives no
    rows; other columns aren't read."""

    def rows(batches):
        p = pieces(model)
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                yield encoded(p, part, n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, ENCODED)


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", "cost", F.element_at("nbest_crc32", 1).alias("ids_crc32"), "nbest_costs", "nbest_crc32", "decoded")
