"""Operator 10: the visible text of HTML pages, laid out: block spacing, lists, aligned table cells.

A tokenizer and tree builder make a tree with the tags that HTML implies; visibility rules prune it; a renderer flows
text into lines, collapses white space and margins, numbers and indents lists, and sets tables in columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
HEAD = frozenset("base basefont bgsound link meta title style script template noscript".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template button object marquee applet".split())
BLOCK = CLOSE_P | frozenset("html body tr tbody thead tfoot caption option optgroup legend textarea select".split())
SPACED = frozenset("blockquote dir dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul xmp fieldset".split())
HIDDEN = frozenset("head script style template title meta link base datalist rp iframe object video audio canvas noembed noframes map param source track area embed frameset".split())
TABLE_PARTS = {"tr": ("tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
BETWEEN = frozenset("table tbody thead tfoot tr".split())
IN_TABLE = frozenset("caption tbody thead tfoot tr td th script style template".split())
SHOWN_INPUTS = frozenset("text search tel url email number submit reset button date time month week datetime-local".split())
BULLETS = "•◦▪"

#: Lines of a cell that has others to its right are wrapped at so many columns; a longer word stays whole and isn't aligned.
WIDE = 80
#: Columns of blanks before a cell at most.
PAD = 1000
#: Lists, quotations and tables within one another that are indented or set in columns; deeper ones flow as blocks.
LEVELS = 50
#: Open elements looked through one by one before the places of tags are consulted.
NEAR = 32
SPACES = re.compile(r"[ \t\n\f\r]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
KEEP_SPACE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(pre|pre-wrap|pre-line|break-spaces)\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree:
    """Builds the tree of a page; any text makes one."""

    def __init__(self, text: str):
        self.root = Node("html", {})
        self.head, self.body = Node("head", {}), Node("body", {})
        self.root.children = [self.head, self.body]
        self.open, self.in_head = [self.root, self.body], True
        #: Where in self.open the elements of a tag are.
        self.places: dict[str, list[int]] = {}
        self.parse(text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text)

    def parse(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self.text(s[at:])
                return
            if lt > at:
                self.text(s[at:lt])
            at = self.markup(s, lt)

    def markup(self, s: str, at: int) -> int:
        """One tag, comment or lone < at `at`; where it ends."""
        c = s[at + 1 : at + 2]
        if c == "!" or c == "?":
            if s.startswith("<!--", at):
                if s.startswith((">", "->"), at + 4):
                    return s.index(">", at) + 1
                end = s.find("-->", at + 4)
                return len(s) if end < 0 else end + 3
            end = s.find(">", at)
            return len(s) if end < 0 else end + 1
        closing = c == "/"
        m = NAME.match(s, at + 1 + closing)
        if not m:
            if closing:
                end = s.find(">", at)
                return len(s) if end < 0 else end + 1
            self.text("<")
            return at + 1
        tag, attrs, at = m[0].lower(), {}, m.end()
        while at < len(s) and s[at] != ">":
            a = ATTRIBUTE.match(s, at)
            if not a or a.end() == at:
                at += 1
                continue
            at, value = a.end(), a[2] or ""
            if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            attrs.setdefault(a[1].lower(), html.unescape(value) if "&" in value else value)
        at += 1
        if closing:
            self.end(tag)
            return at
        self.start(tag, attrs)
        if tag in RAW or tag in ESCAPABLE or tag == "plaintext":
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(s, at) if tag != "plaintext" else None
            stop = end.start() if end else len(s)
            raw = s[at:stop]
            node = self.open[-1] if self.open[-1].tag == tag else None
            if node is not None:
                node.children.append(html.unescape(raw) if tag in ESCAPABLE and "&" in raw else raw)
                self.cut(len(self.open) - 1)
            gt = s.find(">", stop)
            return len(s) if gt < 0 else gt + 1
        return at

    def text(self, s: str) -> None:
        if "&" in s:
            s = html.unescape(s)
        if self.in_head and s.strip(" \t\n\f\r"):
            self.leave_head()
        top = self.open[-1]
        if top.tag in BETWEEN and s.strip(" \t\n\f\r"):
            carrier = Node("span", {})
            carrier.children.append(s)
            self.before_table(carrier)
            return
        if top.children and isinstance(top.children[-1], str):
            top.children[-1] += s
        else:
            top.children.append(s)

    def before_table(self, node: Node) -> None:
        """What isn't in a cell stands before its table."""
        k = self.places["table"][-1]
        parent, table = self.open[k - 1], self.open[k]
        place = next((i for i in range(len(parent.children) - 1, -1, -1) if parent.children[i] is table), len(parent.children))
        parent.children.insert(place, node)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        for x in self.open[i:]:
            self.places[x.tag].pop()
        del self.open[i:]

    def leave_head(self) -> None:
        self.in_head = False
        self.cut(2)

    def find(self, tags, stop) -> int:
        """Index of the innermost open element of these tags not behind one of `stop`; -1 if there is none."""
        low = max(1, len(self.open) - 1 - NEAR)
        for i in range(len(self.open) - 1, low, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stop:
                return -1
        if low == 1:
            return -1
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        return at if at >= 0 and at >= max((self.places[t][-1] for t in stop if self.places.get(t)), default=-1) else -1

    def close(self, tags, stop) -> bool:
        if (i := self.find(tags, stop)) < 0:
            return False
        self.cut(i)
        return True

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            (self.root if tag == "html" else self.body).attrs |= {k: v for k, v in attrs.items() if k not in (self.root if tag == "html" else self.body).attrs}
            if tag == "body":
                self.leave_head()
            return
        if tag == "head":
            return
        if self.in_head:
            if tag in HEAD:
                if tag not in VOID:
                    node = Node(tag, attrs)
                    self.head.children.append(node)
                    if tag in RAW or tag in ESCAPABLE:
                        self.push(node)
                    elif tag == "noscript":
                        self.push(node)
                return
            if len(self.open) == 2 or self.open[-1].tag == "noscript":
                self.leave_head()
        if self.open[-1].tag in BETWEEN:
            if tag == "form":
                return  # a form between cells holds nothing; its fields stand before the table
            if tag == "table":
                self.close(("table",), ())
        if tag in CLOSE_P:
            self.close(("p",), SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        elif tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dd", "dt"):
            self.close(("dd", "dt"), SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close(("option",), SCOPE | {"select", "datalist"})
            if tag == "optgroup":
                self.close(("optgroup",), SCOPE | {"select", "datalist"})
        elif tag in ("rt", "rp"):
            self.close(("rt", "rp"), SCOPE | {"ruby"})
        elif tag == "a":
            self.close(("a",), SCOPE | BLOCK)
        elif tag == "button":
            self.close(("button",), {"table", "td", "th"})
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            if self.find(("table",), ()) < 0:
                return  # parts of a table without a table are passed over; their text stays
            self.table_part(tag)
            if tag in ("colgroup", "col"):
                return
        node = Node(tag, attrs)
        if self.open[-1].tag in BETWEEN and tag not in IN_TABLE:
            self.before_table(node)
        else:
            self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)

    def table_part(self, tag: str) -> None:
        stop = ("table",)
        self.close(("td", "th", "caption"), stop)
        if tag in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            self.close(("tr",), stop)
        if tag in ("tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            self.close(("tbody", "thead", "tfoot"), stop)
        while self.open[-1].tag not in BETWEEN:
            self.cut(len(self.open) - 1)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            if self.open[-1].tag == "table":
                self.imply("tbody")
            self.imply("tr")
        elif tag == "tr" and self.open[-1].tag == "table":
            self.imply("tbody")

    def imply(self, tag: str) -> None:
        node = Node(tag, {})
        self.open[-1].children.append(node)
        self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag in ("html", "body"):
            return
        elif tag == "head":
            self.leave_head() if self.in_head else None
        elif tag == "p":
            if not self.close(("p",), SCOPE):
                self.start("p", {})
                self.close(("p",), SCOPE)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag == "li":
            self.close(("li",), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("td", "th", "caption", "tr", "tbody", "thead", "tfoot"):
            self.close((tag,), ("table",))
        elif tag == "table":
            self.close(("table",), ())
        elif tag in BLOCK:
            self.close((tag,), SCOPE - {tag})
        else:  # an inline element doesn't close blocks within it
            self.close((tag,), SCOPE | BLOCK)


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of text: words of a line, and blank lines owed before the next."""

    def __init__(self, level: int = 0):
        self.level = level
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.owed = 0

    def words(self, s: str) -> None:
        if not s:
            return
        s = SPACES.sub(" ", s)
        if s[0] == " ":
            self.space = self.space or bool(self.line)
            s = s[1:]
            if not s:
                return
        if self.space:
            self.line.append(" ")
        self.space = s[-1] == " "
        self.line.append(s[:-1] if self.space else s)

    def exact(self, s: str) -> None:
        head, *rest = s.split("\n")
        if self.space and head:
            self.line.append(" ")
        self.space = False
        if head:
            self.line.append(head)
        for x in rest:
            self.put()
            if x:
                self.line.append(x)

    def put(self) -> None:
        """End the line, blank or not."""
        self.emit("".join(self.line).replace("\xa0", " ").rstrip())
        self.line, self.space = [], False

    def emit(self, s: str) -> None:
        if self.lines and self.owed:
            self.lines += [""] * self.owed
        self.owed = 0
        self.lines.append(s)

    def block(self, gap: int) -> None:
        """A block's edge: end a line that has text, and owe at least that many blank lines."""
        if self.line:
            self.put()
        self.space = False
        self.owed = max(self.owed, gap)

    def take(self, lines: list[str], first: str, rest: str) -> None:
        for k, x in enumerate(lines):
            lead = rest if k else first
            self.emit((lead + x) if x else (lead.rstrip()))

    def done(self) -> list[str]:
        self.block(0)
        return self.lines


def number(value: str | None, low: int, high: int, otherwise: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})", value or "")
    return min(max(int(m[1]), low), high) if m else otherwise


def roman(n: int) -> str:
    out = ""
    for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
        out += s * (n // v)
        n %= v
    return out


def marker(kind: str, n: int) -> str:
    if kind in "aA" and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
        return s.upper() if kind == "A" else s
    if kind in "iI" and 0 < n < 4000:
        return roman(n).upper() if kind == "I" else roman(n)
    return str(n)


def wrapped(lines: list[str]) -> list[str]:
    """Lines wrapped between words at WIDE columns; no word is cut."""
    out = []
    for x in lines:
        if len(x) * 2 <= WIDE or width(x) <= WIDE:
            out.append(x)
            continue
        now, used = [], 0
        for w in x.split(" "):
            size = width(w)
            if now and used + 1 + size > WIDE:
                out.append(" ".join(now).rstrip())
                now, used = [], 0
            used += size + (1 if now else 0)
            now.append(w)
        out.append(" ".join(now))
    return out


Work = Iterator["Work"]


class Renderer:
    """Renders a tree. Its methods are generators that yield the work inside theirs, so that pages of any depth are
    rendered with a stack of their own."""

    def __init__(self):
        self.items = self.rows = 0

    def run(self, node: Node, flow: Flow) -> None:
        stack = [self.node(node, flow, True, False, 0)]
        while stack:
            if (inner := next(stack[-1], None)) is None:
                stack.pop()
            else:
                stack.append(inner)

    def node(self, node: Node, flow: Flow, seen: bool, pre: bool, depth: int) -> Work:
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN or "hidden" in attrs and attrs["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in attrs:
            return
        if style := attrs.get("style"):
            if UNSEEN.search(style):
                return
            if m := VISIBILITY.search(style):
                seen = m[1].lower() not in ("hidden", "collapse")
            if KEEP_SPACE.search(style):
                pre = True
        if tag == "br":
            flow.put()
        elif tag == "hr":
            flow.block(0)
        elif tag == "input":
            kind = attrs.get("type", "text").lower()
            if seen and (kind in SHOWN_INPUTS or kind not in ("hidden", "password", "checkbox", "radio", "file", "color", "range", "image")):
                flow.words(attrs.get("value", ""))
        elif tag == "select":
            yield self.select(node, flow, seen)
        elif tag in ("ul", "ol", "menu", "dir"):
            yield self.list(node, flow, seen, pre, depth)
        elif tag == "table" and flow.level < LEVELS:
            flow.block(1)
            yield self.table(node, flow, seen, pre, depth)
            flow.block(1)
        elif tag == "details" and "open" not in attrs:
            flow.block(0)
            for x in node.children:
                if isinstance(x, Node) and x.tag == "summary":
                    yield self.node(x, flow, seen, pre, depth)
                    break
            flow.block(0)
        elif tag in ("blockquote", "dd") and flow.level < LEVELS:
            inner = Flow(flow.level + 1)
            yield self.children(node, inner, seen, pre, depth)
            flow.block(tag == "blockquote")
            flow.take(inner.done(), "  ", "  ")
            flow.block(tag == "blockquote")
        else:
            keep = pre or tag in ("pre", "xmp", "textarea", "plaintext", "listing")
            if tag not in BLOCK and tag not in ("pre", "xmp", "td", "th"):
                yield self.children(node, flow, seen, keep, depth)
                return
            gap = int(tag in SPACED)
            flow.block(gap)
            yield self.children(node, flow, seen, keep, depth)
            flow.block(gap)

    def children(self, node: Node, flow: Flow, seen: bool, pre: bool, depth: int) -> Work:
        strip = node.tag in ("pre", "textarea", "listing")
        for k, x in enumerate(node.children):
            if isinstance(x, Node):
                yield self.node(x, flow, seen, pre, depth)
            elif seen:
                if pre:
                    flow.exact(x[1:] if strip and not k and x[:1] == "\n" else x)
                else:
                    flow.words(x)

    def select(self, node: Node, flow: Flow, seen: bool) -> Work:
        """What a closed select shows: its selected option, else the first."""
        options, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag == "option":
                    options.append(x)
                else:
                    stack += reversed(x.children)
        if options:
            yield self.children(next((o for o in options if "selected" in o.attrs), options[0]), flow, seen, False, 0)

    def list(self, node: Node, flow: Flow, seen: bool, pre: bool, depth: int) -> Work:
        flow.block(0 if depth else 1)
        ordered = node.tag == "ol"
        items = [x for x in node.children if isinstance(x, Node) and x.tag == "li"]
        step = -1 if "reversed" in node.attrs else 1
        n = number(node.attrs.get("start"), -(10**9), 10**9, len(items) if step < 0 else 1)
        for x in node.children:
            if not isinstance(x, Node) or x.tag != "li":
                if isinstance(x, Node):
                    yield self.node(x, flow, seen, pre, depth + 1)
                elif seen:
                    flow.words(x)
                continue
            n = number(x.attrs.get("value"), -(10**9), 10**9, n)
            mark = f"{marker((x.attrs.get('type') or node.attrs.get('type') or '1')[:1], n)}. " if ordered else BULLETS[min(depth, 2)] + " "
            box = Node("div", x.attrs)
            box.children = x.children
            if flow.level >= LEVELS:
                flow.block(0)
                flow.words(mark)
                yield self.children(box, flow, seen, pre, depth + 1)
                flow.block(0)
                self.items += 1
                n += step
                continue
            inner = Flow(flow.level + 1)
            yield self.node(box, inner, seen, pre, depth + 1)
            lines = inner.done()
            gone = "hidden" in x.attrs or UNSEEN.search(x.attrs.get("style", ""))
            if not gone:
                n += step
            if lines:
                self.items += 1
                flow.block(0)
                flow.take(lines, mark, " " * len(mark))
        flow.block(0 if depth else 1)

    def table(self, node: Node, flow: Flow, seen: bool, pre: bool, depth: int) -> Work:
        heads, bodies, feet = [], [], []
        for part in node.children:
            if not isinstance(part, Node):
                continue
            if part.tag == "caption" or part.tag not in ("tbody", "thead", "tfoot", "tr"):
                yield self.node(part, flow, seen, pre, depth)
                flow.block(0)
                continue
            if "hidden" in part.attrs or UNSEEN.search(part.attrs.get("style", "")):
                continue
            rows = [part] if part.tag == "tr" else [r for r in part.children if isinstance(r, Node) and r.tag == "tr"]
            (heads if part.tag == "thead" else feet if part.tag == "tfoot" else bodies).extend(rows)
        held: dict[int, int] = {}  # column: rows for which a cell above still holds it
        grid: list[list[tuple[int, int, list[str]]]] = []
        widths: dict[int, int] = {}
        for row in heads + bodies + feet:
            if "hidden" in row.attrs or UNSEEN.search(row.attrs.get("style", "")):
                continue
            at, line, new = 0, [], {}
            for cell in row.children:
                if not isinstance(cell, Node):
                    continue
                while held.get(at, 0) > 0:
                    at += 1
                inner = Flow(flow.level + 1)
                box = Node("div", cell.attrs)
                box.children = cell.children
                yield self.node(box, inner, seen, pre, depth)
                lines = inner.done()
                span = number(cell.attrs.get("colspan"), 1, 1000, 1)
                line.append((at, span, lines))
                down = number(cell.attrs.get("rowspan"), 0, 65534, 1) or 65534
                if down > 1:
                    new |= dict.fromkeys(range(at, at + span), down)
                at += span
            held = {c: k - 1 for c, k in (held | new).items() if k > 1}
            grid.append(line)
        last = max((c for line in grid for c, _, lines in line if lines), default=0)
        grid = [[(c, span, wrapped(lines) if c < last else lines) for c, span, lines in line] for line in grid]
        for line in grid:
            for c, span, lines in line:
                if span == 1:
                    widths[c] = max(widths.get(c, 0), *(w for x in lines if (w := width(x)) <= WIDE or c == last), 0)
        columns = sorted(c for c, w in widths.items() if w)
        start, at = {}, 0
        for c in columns:
            start[c] = at
            at += widths[c] + 2
        for line in grid:
            tall = max((len(x) for _, _, x in line), default=0)
            shown = False
            for k in range(tall):
                text, used = "", 0
                for c, _, lines in line:
                    if k < len(lines) and lines[k]:
                        to = start.get(c, start[columns[i]] if (i := next((i for i, x in enumerate(columns) if x > c), None)) is not None else at)
                        pad = min(max(to - used, 2 if used else 0), PAD)
                        text += " " * pad + lines[k]
                        used += pad + width(lines[k])
                flow.emit(text.rstrip())
                shown = True
            self.rows += shown


def render(page: str | None) -> tuple[str, int, int]:
    """The visible text of a page, and how many list items and table rows it has. Null and empty pages: no text."""
    if not page:
        return "", 0, 0
    tree, r, flow = Tree(page), Renderer(), Flow()
    r.run(tree.body, flow)
    return "\n".join(flow.done()).strip("\n"), r.items, r.rows


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_items, n_rows of every row of pages (page_id, html), each by itself: repeated rows and rows
    without an id stay, null pages have an empty text, an empty table gives no rows. Other columns aren't read.

    Elements may nest to any depth; lists, quotations and tables within more than LEVELS others flow as blocks. In a table, lines of a cell that has others to its right are wrapped at WIDE columns
    between words; a longer word stays whole, and so isn't aligned with; PAD bounds the blanks before a cell."""

    def rows(batches):
        for batch in batches:
            for part in common.slices(batch, "html", 4 << 20):
                got = [render(x) for x in part.column("html").to_pylist()]
                text, items, lines = zip(*got, strict=True)
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "text": pa.array(text, pa.string()), "n_items": pa.array(items, pa.int64()), "n_rows": pa.array(lines, pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(rows, "page_id long, text string, n_items long, n_rows long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
