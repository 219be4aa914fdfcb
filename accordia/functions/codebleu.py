"""CodeBLEU: n-gram, keyword-weighted n-gram, syntax-tree and data-flow match, a quarter each.

Trees and data flow are of Python code, by its own parser; where a side doesn't parse, and for other languages, the
n-gram parts stand alone, half each.
"""

from __future__ import annotations

import ast
import keyword
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .pairs import clipped, coded_words, squares


def _weight(g: tuple[str, ...]) -> float:
    return 1.0 if keyword.iskeyword(g[0]) else 0.2


def _trees(node: ast.AST, out: Counter) -> str:
    s = f"({type(node).__name__}{''.join(_trees(c, out) for c in ast.iter_child_nodes(node))})"
    out[s] += 1
    return s


def _flow(tree: ast.AST) -> Counter:
    """Pairs of a name that is set and one that is used in setting it, by order of appearance."""
    names: dict[str, int] = {}
    number = lambda x: names.setdefault(x, len(names))
    out: Counter = Counter()
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            used = [number(x.id) for x in ast.walk(node.value) if isinstance(x, ast.Name)]
            for t in (x for y in targets for x in ast.walk(y) if isinstance(x, ast.Name)):
                out.update((number(t.id), u) for u in used or [-1])
    return out


def _share(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum(a.values())) if a else 1.0 if not b else 0.0


class Side:
    """What a text is compared by: n-gram counts, and tree and data-flow counts where it is Python code that parses."""

    __slots__ = ("size", "grams", "total", "weighted", "trees", "flow")

    def __init__(self, text: str, lang: str = "python"):
        words = text.split()
        self.size = len(words)
        self.grams = [Counter(zip(*(words[i:] for i in range(n)), strict=False)) for n in range(1, 5)]
        self.total = [float(max(sum(x.values()), 1)) for x in self.grams]
        self.weighted = sum(c * _weight(g) for g, c in self.grams[0].items())
        self.trees = self.flow = None
        if parsed := _parsed(text, lang):
            self.trees, self.flow = parsed


def _bleus(a: Side, b: Side) -> list[float]:
    """Of all words alike, and with keywords weighted."""
    first = [(min(c, y), g) for g, c in a.grams[0].items() if (y := b.grams[0].get(g))]
    if not first:
        return [0.0, 0.0]
    more = []
    for x, y, of in zip(a.grams[1:], b.grams[1:], a.total[1:], strict=True):
        hit = sum([min(c, y[g]) for g, c in x.items() if g in y])
        more.append(math.log((hit or 0.1) / of) / 4)
    short = 1.0 if a.size > b.size else math.exp(1 - b.size / a.size)
    out = []
    for hit, of in ((sum([c for c, _ in first]), a.total[0]), (sum([c * _weight(g) for c, g in first]), a.weighted)):
        logs = math.log(hit / of) / 4
        for x in more:
            logs += x
        out.append(math.exp(logs) * short)
    return out


def _score(a: Side, b: Side) -> float:
    parts = _bleus(a, b)
    if a.trees is not None and b.trees is not None:
        parts += [_share(b.trees, a.trees), _share(b.flow, a.flow)]
    return sum(parts) / len(parts)


def score(a: str, b: str, lang: str = "python") -> float:
    """Of a against the reference b."""
    return _score(Side(a, lang), Side(b, lang))


def _parsed(text: str, lang: str) -> tuple[Counter, Counter] | None:
    if lang != "python":
        return None
    try:
        tree, trees = ast.parse(text), Counter()
        _trees(tree, trees)
        return trees, _flow(tree)
    except (SyntaxError, ValueError, RecursionError):
        return None


def scores(texts: pa.Array, group: np.ndarray, size: np.ndarray, lang: str) -> np.ndarray:
    """Symmetric score of all ordered pairs of texts that pairs.squares(size) lists; group ascends. N-grams of a group's
    texts are matched side by side, each text is parsed once; trees are compared of the pairs that parse."""
    owner, known, named, at = coded_words(pc.utf8_split_whitespace(texts))
    key = np.array([keyword.iskeyword(w) for w in known.to_pylist()], bool)[at] if len(at) else np.zeros(0, bool)
    length, keys = (np.bincount(o, minlength=len(texts)) for o in (owner, owner[key]))
    m, hit_keys = clipped(owner, named[at], group, size), clipped(owner[key], named[at][key], group, size, 1)[0]
    weighted = 0.2 * (length - keys) + keys
    x, y, _ = squares(size)
    any_ = m[0] > 0
    more = lambda a, n: np.log(np.where(m[n] == 0, 0.1, m[n]) / np.maximum(a - n, 1)) / 4

    def directed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = length[x], length[y]
        short = np.where(a > b, 1.0, np.exp(1 - b / np.maximum(a, 1)))
        total = np.zeros(len(x))
        for hit, of in ((m[0], a), (0.2 * (m[0] - hit_keys) + hit_keys, weighted[x])):
            logs = np.log(np.where(any_, hit, 1) / np.where(any_, of, 1)) / 4
            for n in range(1, len(m)):
                logs = logs + more(a, n)
            total += np.where(any_, np.exp(logs) * short, 0.0)
        return total

    one, other, parts = directed(x, y), directed(y, x), np.full(len(x), 2.0)
    trees = [_parsed(s, lang) for s in texts.to_pylist()]
    parses = np.array([t is not None for t in trees], bool)
    for k in np.flatnonzero(parses[x] & parses[y]).tolist():
        (tree_a, flow_a), (tree_b, flow_b) = trees[x[k]], trees[y[k]]
        one[k] += _share(tree_b, tree_a) + _share(flow_b, flow_a)
        other[k] += _share(tree_a, tree_b) + _share(flow_a, flow_b)
        parts[k] = 4.0
    blank = length == 0
    return np.where(blank[x] | blank[y], (blank[x] & blank[y]).astype(float), (one / parts + other / parts) / 2)


@F.udf(DoubleType(), useArrow=True)
def symmetric(a: str | None, b: str | None, lang: str | None):
    """Mean of both directions; 1 for two blank sides, 0 for one."""
    a, b = a or "", b or ""
    if not a.strip() or not b.strip():
        return float(a.strip() == b.strip())
    return (score(a, b, lang or "") + score(b, a, lang or "")) / 2
