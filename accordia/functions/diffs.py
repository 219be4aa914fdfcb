"""Unified diffs as rows of (file, removed, added)."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CHANGES = ArrayType(StructType([StructField("file", StringType()), StructField("removed", StringType()), StructField("added", StringType())]))


_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def _path(header: str) -> str | None:
    """A path without quotes, timestamp and a/ or b/; None for /dev/null and nothing."""
    name = header.split("\t")[0].strip()
    if name[:1] == '"':
        try:
            name = shlex.split(name)[0]
        except (ValueError, IndexError):
            name = name.strip('"')
    if name in ("", "/dev/null"):
        return None
    return name[2:] if name[:2] in ("a/", "b/") else name


def parse(diff: str | None) -> list[tuple[str, str, str]]:
    """One row per changed file in order of appearance, its removed and added lines of all hunks joined.

    A file's target path names it; a deleted file keeps its source path. A hunk has the lines that its header counts, so
    that a changed line may begin with -- or ++, or hold other line separators. Context, metadata and lines beyond those
    counts, or without them, that begin with +++ or --- count for nothing. A file without a hunk still has its row. Null
    and blank: no rows.
    """
    rows: dict[str, tuple[list[str], list[str]]] = {}
    source = name = None
    inside = False
    lines = re.split(r"\r?\n", diff or "")
    skip = False
    left = {"-": 0, "+": 0}
    for line, after in zip(lines, [*lines[1:], ""], strict=False):
        if skip:
            skip = False
            continue
        if left.get(line[:1], 0) > 0:
            left[line[0]] -= 1
            if name is not None:
                rows.setdefault(name, ([], []))[line[0] == "+"].append(line[1:])
            continue
        if line[:1] in ("", " ") and min(left.values()) > 0:
            left = {k: n - 1 for k, n in left.items()}
            continue
        if line.startswith("diff --git "):
            left = {"-": 0, "+": 0}
            try:
                words = shlex.split(line)[2:]
            except ValueError:
                words = line.split()[2:]
            source = _path(words[0]) if words else None
            name, inside = (_path(words[1]) if len(words) > 1 else None) or source, False
        elif line.startswith("--- ") and after.startswith("+++ "):
            source = _path(line[4:]) or source
            name, inside, skip = _path(after[4:]) or source, False, True
        elif line.startswith("@@"):
            inside = True
            if counts := _HUNK.match(line):
                left = {"-": int(counts[1] or 1), "+": int(counts[2] or 1)}
        else:
            if inside and name is not None and line[:3] not in ("+++", "---") and line[:1] in ("+", "-"):
                rows.setdefault(name, ([], []))[line[0] == "+"].append(line[1:])
            continue
        if name is not None:
            rows.setdefault(name, ([], []))
    return [(f, "\n".join(a), "\n".join(b)) for f, (a, b) in rows.items()]


@F.udf(CHANGES, useArrow=True)
def parse_diff(diff: str | None):
    """parse() as a column function; explode it for rows."""
    return parse(diff)


def changed_paths(diff: Column) -> Column:
    """Paths after b/ on the diff --git lines, first appearance first."""
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git \S+ b/(\S+)"), F.lit(1)))


def has_test_file(paths: Column) -> Column:
    return F.exists(paths, lambda p: F.lower(p).contains("test"))


# Suffixes of files that a fix isn't judged by.
IGNORED = (
    "md mdx txt rst asciidoc png jpg jpeg gif svg webp ico icns mp3 ogg wav mp4 webm flac m4a aiff opus wma "
    "ttf otf woff woff2 zip tar gz rpm deb exe dll bin wasm jar aar o pdb sqlite db snap golden expected output "
    "stdout stderr patch diff log pem crt key pub gpg pgp sig asc keytab psd1 metadata thumbnail cache"
).split()


def extension(path: Column) -> Column:
    """The lower-cased last suffix of the file's name, or [no extension]."""
    ext = F.regexp_extract(F.lower(path), r"(?:^|/)[^/]+\.([^./]+)$", 1)
    return F.when(ext == "", "[no extension]").otherwise(ext)


def is_source(path: Column) -> Column:
    return ~extension(path).isin(*IGNORED)


def is_safe(path: Column) -> Column:
    """Relative and without a step upwards."""
    return ~path.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") & (F.trim(path) != "")


def is_solution(path: Column) -> Column:
    """Neither a README nor below a top folder of documentation, tests or examples."""
    low = F.lower(F.trim(path))
    name = F.substring_index(low, "/", -1)
    return ~((name == "readme") | name.startswith("readme.") | low.rlike(r"^(docs|tests?|examples?)/"))


def changed_text(changes: Column) -> Column:
    """The changed lines of rows as parse_diff gives them: each file's removed ones and added ones, blank texts left out."""
    parts = F.flatten(F.transform(changes, lambda c: F.array(c["removed"], c["added"])))
    return F.array_join(F.filter(parts, lambda x: x.rlike(r"\S")), "\n")


def gold_recall(gold: Column, prompt: Column) -> Column:
    """Percentage of the gold list's entries that the prompt has; 0 for an empty list."""
    hits = F.size(F.filter(gold, lambda x: F.array_contains(prompt, x)))
    return F.when(F.size(gold) > 0, 100.0 * hits / F.size(gold)).otherwise(0.0)
