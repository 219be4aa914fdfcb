"""Statistics that run in Python: the bootstrap over issues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEED, DRAWS = 20260819, 10_000


def interval(values: np.ndarray, seed: int, draws: int = DRAWS) -> tuple[float | None, float | None]:
    """2.5 and 97.5 percentiles of the mean over resamples; none for under two values. Values come in issue order."""
    if len(values) < 2:
        return None, None
    rng, means, done = np.random.default_rng(seed), [], 0
    while done < draws:
        k = min(draws - done, max(1, 4_000_000 // len(values)))
        means.append(values[rng.integers(0, len(values), size=(k, len(values)))].mean(axis=1))
        done += k
    low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
    return float(low), float(high)


def bootstrap(deltas: DataFrame, numbers: list[int], by_threshold: bool = False) -> DataFrame:
    """passing, [t10,] issues, mean, low, high, text from rows (passing int, [t10 int,] issue, delta double). A group is
    the issues with one number of passing candidates (at one threshold); its seed follows from its place among those
    numbers, which are those of all issues, comparable or not."""
    counts = {m: k for k, m in enumerate(sorted(set(numbers)), 1)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["passing"].iloc[0])
        v = pdf.sort_values("issue")["delta"].to_numpy()
        key = {"passing": m, "t10": int(pdf["t10"].iloc[0])} if by_threshold else {"passing": m}
        seed = SEED + 10_000 * counts[m] + key["t10"] - 1 if by_threshold else SEED + 1000 * counts[m] + m
        low, high = interval(v, seed)
        return pd.DataFrame([key | {"issues": len(v), "mean": float(v.mean()), "low": low, "high": high, "text": "NA" if low is None else f"[{low:.4f}, {high:.4f}]"}])

    keys = ["passing", "t10"] if by_threshold else ["passing"]
    return deltas.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} int" for k in keys) + ", issues long, mean double, low double, high double, text string")
