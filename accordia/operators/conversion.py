"""Model answers into patches: edits applied to the issue's files, with fallbacks, statuses and totals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import edits
from ..functions.pairs import by_issue, codes

RESULT = StructType([StructField(n, StringType()) for n in ("patch", "syntax", "kinds")])
FALLBACK = "ARTIFICIAL_FALLBACK_DIFF"


def convert(answer: str | None, sources: dict[str, str] | None) -> tuple[str | None, str, str]:
    """(patch, syntax status, how places were found). No answer: MISSING. Edits of a file apply one after another; if any
    fails, the patch is a diff of the edits alone; without an edit to make one of, ERROR. A syntax status is the worst of
    the changed files'."""
    if answer is None:
        return None, "MISSING", ""
    found = edits.extract(answer)
    if not found:
        return None, "ERROR", ""
    before, after, kinds = dict(sources or {}), dict(sources or {}), []
    try:
        for path, old, new in found:
            if path not in after or path.startswith("/") or ".." in path.split("/"):
                raise ValueError("no such file")
            if old == new:
                after[path], kind = edits.spaced(after[path]), "no-op"
            else:
                after[path], kind = edits.apply(after[path], old, new)
            kinds.append(kind)
    except ValueError:
        return edits.fallback_diff(found), FALLBACK, " | ".join(kinds)
    changed = [p for p in after if after[p] != before[p]]
    patch = "".join(edits.unified(p, before[p], after[p]) for p in changed)
    return patch, str(min((edits.syntax(p, after[p]) for p in changed), default=1)), " | ".join(kinds)


@F.udf(RESULT, useArrow=True)
def _convert(answer):
    return convert(answer, None)


def predictions(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """issue, t, patch, syntax, kinds from answers (issue, t, answer) and sources (issue, path, content). Both are dealt by
    issue together, without a join; an issue's equal answers are converted once. Of a path that comes twice the last
    content counts, by their order."""
    kind, place = (answers.schema[c].dataType.simpleString() for c in ("issue", "t"))
    own = answers.selectExpr("issue", "t", "answer", "cast(NULL AS string) AS path", "cast(NULL AS string) AS content", "true AS own")
    given = sources.selectExpr(f"cast(issue AS {kind}) AS issue", f"cast(NULL AS {place}) AS t", "cast(NULL AS string) AS answer", "path", "content", "false AS own")

    def run(t: pa.Table) -> pa.Table:
        issue, own = codes(t.column("issue")), np.asarray(t.column("own").combine_chunks())
        held: dict[int, list[tuple[str | None, str | None]]] = {}
        some = np.flatnonzero(~own)
        for k, *file in zip(issue[some].tolist(), *(t.column(c).take(pa.array(some)).to_pylist() for c in ("path", "content")), strict=True):
            held.setdefault(k, []).append(tuple(file))
        rows = np.flatnonzero(own)
        answer = t.column("answer").take(pa.array(rows))
        code = codes(answer)
        _, first, back = np.unique(issue[rows] * (int(code.max(initial=0)) + 1) + code, return_index=True, return_inverse=True)
        got = [convert(x, dict(sorted(held.get(k, ()), key=lambda f: [(x is not None, x or "") for x in f]))) for x, k in zip(answer.take(pa.array(first)).to_pylist(), issue[rows[first]].tolist(), strict=True)]
        cells = {n: pa.array([r[k] for r in got], pa.string()).take(pa.array(back)) for k, n in enumerate(RESULT.names)}
        return pa.table({c: t.column(c).take(pa.array(rows)) for c in ("issue", "t")} | cells)

    converted = by_issue(own.unionByName(given), run, f"issue {kind}, t {place}, patch string, syntax string, kinds string")
    stray = answers.where("issue IS NULL").select("issue", "t", _convert("answer").alias("r")).select("issue", "t", "r.*")
    return converted.unionByName(stray)


def kind_class(kind):
    return F.when(kind == "exact string match", "exact").when(kind.startswith("full indentation"), "indentation_insensitive").when(kind.startswith("first/last"), "anchor").when(kind == "first line matching", "first_line").otherwise("other")


def totals(converted: DataFrame) -> DataFrame:
    """One row per issue: cells by status and edits by how their places were found."""
    kinds = F.filter(F.split("kinds", r" \| "), lambda k: k != "")
    per = converted.select("issue", "syntax", F.transform(kinds, kind_class).alias("c"))
    count = lambda x: F.sum(F.size(F.filter("c", lambda k: k == x))).cast("long")
    return per.groupBy("issue").agg(
        F.count_if(F.col("syntax").isin("0", "1")).alias("converted"), F.count_if(F.col("syntax") == FALLBACK).alias("fallbacks"), F.count_if(F.col("syntax").isin("ERROR", "MISSING")).alias("failed"),
        count("exact").alias("exact"), count("indentation_insensitive").alias("indentation_insensitive"), count("anchor").alias("anchor"), count("first_line").alias("first_line"),
    )
