"""Answers of a model to prompts at several temperatures, by a client that the caller supplies."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class Policy(NamedTuple):
    """Which errors may pass: those with one of these status codes (a client's errors that carry one), else those whose
    text has one of these words, but for the ones that trying again can't help."""

    codes: frozenset[int]
    words: tuple[str, ...]
    never: tuple[str, ...] = ()


# The policies of three kinds of clients.
POLICIES = {
    "status": Policy(frozenset({408, 409, 429, 500, 502, 503, 504, 529}), ("rate limit", "timeout", "timed out", "connection", "temporarily unavailable", "overloaded", "internal server error")),
    "text": Policy(frozenset(), ("429", "500", "502", "503", "504", "rate limit", "timeout", "timed out", "connection", "temporarily unavailable", "overloaded", "internal server error")),
    "hosted": Policy(frozenset(), ("503", "server is overloaded", "not ready", "overloaded", "429", "rate limit", "timeout", "timed out", "connection", "temporarily unavailable"), ("402", "credit limit", "credit_limit", "add credits")),
}


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def retry_class(error: Column, policy: str, code: Column | None = None) -> Column:
    """retry, never or give up, of error texts (and status codes, null where an error has none)."""
    p, low = POLICIES[policy], F.lower(error)
    again = _has(low, p.words)
    if code is not None and p.codes:
        again = F.when(code.isNotNull(), code.isin(*sorted(p.codes))).otherwise(again)
    return F.when(_has(low, p.never), "never").when(again, "retry").otherwise("give up")


def retryable(error: Exception | str, policy: str = "text") -> bool:
    """The same of one error."""
    p, low = POLICIES[policy], str(error).lower()
    code = getattr(error, "status_code", None)
    if any(w in low for w in p.never):
        return False
    return code in p.codes if p.codes and code is not None else any(w in low for w in p.words)


def ask(client: Callable[[str, float, int], str], prompt: str, temperature: float, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, policy: str = "text") -> tuple[str | None, str | None]:
    """(answer, error). Errors that may pass are tried again after min(30, 2**attempt) seconds and up to two more."""
    room = max(2048, min(-(-len(prompt) // 40), 64_000))
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return client(prompt, temperature, room), None
        except Exception as e:  # noqa: BLE001  a client may raise anything; the row keeps what it said
            error = f"{type(e).__name__}: {e}"
            if attempt == attempts or not retryable(e, policy):
                break
            sleep(min(30, 2**attempt) + random.uniform(0, 2))
    return None, error


def answers(prompts: DataFrame, make_client: Callable[[], Callable[[str, float, int], str]], temperatures: int = 11, attempts: int = 3, policy: str = "text") -> DataFrame:
    """issue, t, answer, error from prompts (issue string, text string); one client per task."""

    def run(frames):
        client = make_client()
        for frame in frames:
            rows = [(i, t, *ask(client, text, t / 10, attempts, policy=policy)) for i, text in zip(frame["issue"], frame["text"], strict=True) for t in range(temperatures)]
            yield pd.DataFrame(rows, columns=["issue", "t", "answer", "error"])

    return prompts.select("issue", "text").mapInPandas(run, "issue string, t int, answer string, error string")
