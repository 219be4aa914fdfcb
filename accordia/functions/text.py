"""Text expressions: tokens, n-gram multisets as arrays, smoothed sentence BLEU without a join."""

from __future__ import annotations

MAX_N = 4
#: What stands in for a count of no matching n-gram.
SMOOTH = 0.1


def tokens(text: str) -> str:
    """White-space tokens of a text expression."""
    return rf"filter(split(coalesce({text}, ''), '\\s+'), x -> x <> '')"


def grams(tok: str, n: int) -> str:
    """Sorted hashes of a token array's n-grams."""
    return f"array_sort(if(size({tok}) >= {n}, transform(sequence(1, size({tok}) - {n} + 1), i -> xxhash64(array_join(slice({tok}, i, {n}), ' '))), cast(array() as array<bigint>)))"


def occurrences(sorted_grams: str) -> str:
    """The multiset as a set: each hash with its count so far, so that array_intersect clips matches as BLEU does."""
    return f"transform({sorted_grams}, (x, i) -> xxhash64(x, i - array_position({sorted_grams}, x)))"


def directed(cand: str, ref: str) -> str:
    """BLEU of one direction from {m1..m4} and the two lengths."""
    logs = " + ".join(f"ln(if(m{n} = 0, {SMOOTH}D, cast(m{n} as double)) / greatest(1, {cand} - {n - 1}))" for n in range(1, MAX_N + 1))
    return f"if(m1 = 0, 0D, if({cand} > {ref}, 1D, exp(1D - {ref} / cast({cand} as double))) * exp(0.25D * ({logs})))"


def symmetric(a: str, b: str) -> str:
    """Mean of both directions, 1 for two empty sides and 0 for one, clamped and rounded to six places."""
    return f"round(CASE WHEN {a} = 0 AND {b} = 0 THEN 1D WHEN {a} = 0 OR {b} = 0 THEN 0D ELSE least(1D, greatest(0D, ({directed(a, b)} + {directed(b, a)}) / 2D)) END, 6)"
