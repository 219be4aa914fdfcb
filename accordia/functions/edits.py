"""Edit instructions of model answers: extraction, location, application, fallback diffs, syntax."""

from __future__ import annotations

import ast
import configparser
import difflib
import json
import re
import textwrap
import tomllib
import xml.etree.ElementTree as ET
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

FIELDS = ("file", "replace_this", "with_this")
EDITS = ArrayType(StructType([StructField(n, StringType()) for n in ("file_path", "old_segment", "new_segment")]))
APPLIED = StructType([StructField("text", StringType()), StructField("kinds", StringType()), StructField("error", StringType())])
# Least likeness of an anchored span, how far it may reach (lines more, times as long), names of the ways.
LIKE, MORE, TIMES = 0.50, 40, 2.5
EXACT, WHOLE, ANCHORED, HEADED = "exact string match", "full indentation-insensitive match", "first/last anchor match, score=", "first line matching"

_TAG = re.compile(r'<\s*(/?)\s*"?(edits|edit|file|replace_this|with_this)[^>]*>', re.I)


class Tag(NamedTuple):
    name: str
    closing: bool
    start: int
    end: int


def _tags(text: str) -> list[Tag]:
    return [Tag(m[2].lower(), bool(m[1]), m.start(), m.end()) for m in _TAG.finditer(text)]


def _inner(s: str) -> str:
    """What a field holds: the line end after its opening tag and the one before its closing tag are markup, with the
    blanks between them and the tag."""
    head, end, rest = s.partition("\n")
    if end and not head.strip(" \t\r"):
        s = rest
    rest, end, tail = s.rpartition("\n")
    return rest.removesuffix("\r") if end and not tail.strip(" \t") else s


def _fields(text: str, tags: list[Tag], end: int) -> tuple[str, ...] | None:
    """The three fields of an edit whose tags these are, in their order; None if one has no opening tag.

    A field lasts to its own closing tag, unless the next field opens before; then, or where no such tag is left, a
    closing tag of another field right before counts as the one that was meant.
    """
    out: list[str] = []
    left = iter(tags)
    now = next(left, None)
    for nth, field in enumerate(FIELDS):
        while now and (now.closing or now.name != field):
            now = next(left, None)
        if not now:
            return None
        begin, wrong = now.end, None
        following = FIELDS[nth + 1 : nth + 2]
        for now in left:
            if now.closing and now.name == field or not now.closing and now.name in following:
                break
            if now.closing and now.name in FIELDS:
                wrong = now
        else:
            now = None
        stop = now.start if now else end
        if not (now and now.closing) and wrong and not text[wrong.end : stop].strip():
            stop = wrong.start
        out.append(_inner(text[begin:stop]))
    return tuple(out)


def extract(answer: str | None) -> list[tuple[str, str, str]]:
    """Edits (file, old, new) of the answer's first complete <edits> block, or of its lone <edit> blocks. Blocks that
    can't be repaired are left out; null has none."""
    text = answer or ""
    tags = _tags(text)
    opened = next((k for k, t in enumerate(tags) if t.name == "edits" and not t.closing), None)
    if opened is not None and (closed := next((k for k in range(opened, len(tags)) if tags[k].name == "edits" and tags[k].closing), None)):
        tags = tags[opened + 1 : closed]
    out, first = [], None
    for k, t in enumerate(tags):
        if t.name != "edit" or (first is None) == t.closing:
            continue
        if first is None:
            first = k
            continue
        if got := _fields(text, tags[first + 1 : k], t.start):
            out.append((got[0].strip(), *got[1:]))
        first = None
    return out


class Span(NamedTuple):
    """Lines [start, end) that an edit may mean; of several the likest counts, then the one whose length is nearest."""

    like: float
    drift: float
    start: int
    end: int


def _spans(bare: list[str], goal: list[str]) -> tuple[str, list[Span]]:
    """The first way that finds any lines, and all that it finds."""
    n, places = len(goal), defaultdict(list)
    for i, x in enumerate(bare):
        places[x].append(i)
    heads = [i for i in places[goal[0]] if i + n <= len(bare)]
    if whole := [Span(1.0, 0.0, i, i + n) for i in heads if bare[i : i + n] == goal]:
        return WHOLE, whole
    dense, reach = [x for x in goal if x], max(n + MORE, int(n * TIMES))
    lasts, anchored = places[dense[-1]], []
    for i in places[dense[0]]:
        for j in lasts[bisect_left(lasts, i) : bisect_left(lasts, i + reach)]:
            like = difflib.SequenceMatcher(None, dense, [x for x in bare[i : j + 1] if x]).ratio()
            anchored.append(Span(round(like, 9), round(abs(j + 1 - i - n) / n, 9), i, j + 1))
    return (ANCHORED, anchored) if anchored else (HEADED, [Span(1.0, 0.0, i, i + n) for i in heads])


def locate(text: str, old: str) -> tuple[int, int, str]:
    """Lines [start, end) of text that old stands for, and how they were found. Raises ValueError if that isn't clear."""
    goal = "\n".join(x.strip() for x in old.splitlines()).strip("\n").split("\n")
    if goal == [""]:
        raise ValueError("nothing to replace")
    kind, spans = _spans([x.strip() for x in text.splitlines()], goal)
    if not spans:
        raise ValueError("not found")
    best = max(spans, key=lambda s: (s.like, -s.drift))
    if best.like < LIKE:
        raise ValueError("anchors match too weakly")
    if sum(s[:2] == best[:2] for s in spans) > 1:
        raise ValueError("ambiguous")
    return best.start, best.end, f"{kind}{best.like:.3f}" if kind == ANCHORED else kind


def reindent(new: str, place: str, text: str) -> str:
    """new as it stands in text instead of place: at the indentation of place's first line that isn't blank, with the
    text's line ends, and with one at the end if place has one. An empty text deletes."""
    body = textwrap.dedent(new).strip("\r\n")
    if not body:
        return ""
    indent = re.match(r"[ \t]*", next(filter(str.strip, place.splitlines()), ""))[0]
    lines = textwrap.indent(body, indent).splitlines()
    return ("\r\n" if "\r\n" in text else "\n").join([*(x if x.strip() else "" for x in lines), *([""] if place.endswith("\n") else [])])


def apply(text: str, old: str, new: str) -> tuple[str, str]:
    """The text after one edit, and how its place was found. Raises ValueError for no or several places, or no change."""
    old, new = old.strip("\n\r"), new.strip("\n\r")
    before, found, after = text.partition(old) if old else (text, "", "")
    kind = EXACT
    if found:
        if text.count(old) > 1:
            raise ValueError("ambiguous")
    else:
        i, j, kind = locate(text, old)
        lines = text.splitlines(keepends=True)
        before, found, after = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    out = before + reindent(new, found, text) + after
    if out == text:
        raise ValueError("no change")
    return out, kind


@F.udf(EDITS, useArrow=True)
def extract_edits(answer: str | None):
    return extract(answer)


@F.udf(APPLIED, useArrow=True)
def apply_edits(text: str | None, olds: list[str], news: list[str]):
    """Edits of one file, one after another; the first failure ends it with its reason and no text."""
    kinds, now = [], text or ""
    try:
        for old, new in zip(olds, news, strict=True):
            now, kind = apply(now, old, new)
            kinds.append(kind)
    except ValueError as e:
        return None, " | ".join(kinds), str(e)
    return now, " | ".join(kinds), None


def unified(path: str, old: str, new: str) -> str:
    """A diff in git's layout."""
    body = list(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{path}", f"b/{path}"))
    lines = [x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in body]
    return f"diff --git a/{path} b/{path}\n" + "".join(lines) if lines else ""


def fallback_diff(edits: list[tuple[str, str, str]]) -> str:
    """A diff of the edits alone, by file, for answers whose places can't be found; at least one changed line."""
    files: dict[str, tuple[list[str], list[str]]] = {}
    for path, old, new in edits:
        a, b = files.setdefault(path, ([], []))
        a.append(old)
        b.append(new)
    out = "".join(unified(p, "\n\n".join(a) + "\n", "\n\n".join(b) + "\n") for p, (a, b) in files.items())
    if out or not edits:
        return out
    path, old, _ = edits[0]
    return unified(path, old + "\n", spaced(old + "\n"))


def spaced(text: str) -> str:
    """A blank line after each line."""
    return text.replace("\n", "\n\n") + "\n"


try:
    import yaml

    _YAML_ERRORS: tuple[type[Exception], ...] = (yaml.YAMLError,)
except ModuleNotFoundError:
    yaml, _YAML_ERRORS = None, ()


def _yaml(text: str) -> None:
    """Reads every document's structure, of whatever tags."""
    if yaml:
        for _ in yaml.compose_all(text, yaml.SafeLoader):
            pass


def syntax(path: str | None, text: str | None) -> int:
    """1 if the file parses, or is of a kind that isn't checked here (YAML: where no parser is installed); else 0."""
    suffix = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    check = {
        "json": json.loads, "xml": ET.fromstring, "toml": tomllib.loads, "py": ast.parse,
        "yaml": _yaml, "yml": _yaml,
        "ini": lambda s: configparser.ConfigParser().read_string(s), "cfg": lambda s: configparser.ConfigParser().read_string(s),
    }.get(suffix)
    if check is None:
        return 1
    try:
        check(text or "")
    except (ValueError, SyntaxError, ET.ParseError, configparser.Error, RecursionError, *_YAML_ERRORS):
        return 0
    return 1


@F.udf(IntegerType(), useArrow=True)
def syntax_ok(path: str | None, text: str | None):
    return syntax(path, text)
