import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from accordia.llm.html_text import extract, op10_html_extraction, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<h1>T</h1>a <b>b</b>  c<p>d<p>e", "T\n\na b c\n\nd\n\ne"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z", "• one\n• two\n  3. x\n  4. y\n\nz"),
        ("<ol reversed><li>a<li>b</ol><ol type=i><li>c<li value=9>d</ol>", "2. a\n1. b\n\ni. c\nix. d"),
        ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>x<table><tr><td>in</table></table>", "x\n\nin"),
        ("<table>foo<tr><td>x</table>", "foo\n\nx"),
        ("<pre>\n a\n   b</pre>", " a\n   b"),
        ("a<div style='display:none'>no</div><p hidden>no<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "a\nyes"),
        ("<head><title>no</title><style>no</style></head><script>if(a<b)'</p>'</script>yes<template>no</template>", "yes"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("a &lt;b&gt; &amp;amp; &copy x&nbsp;y", "a <b> &amp; © x y"),
        ("<select><option>p<option selected>q</select><input value=v><input type=hidden value=no>", "qv"),
        ("<p>a</b>b</p><i>c<p>d</i>e", "ab\n\nc\n\nde"),
        ("a<br>b<br/><br>c", "a\nb\n\nc"),
        ("<blockquote>q<p>r</blockquote><dl><dt>D<dd>def</dl>", "  q\n\n  r\n\nD\n  def"),
        ("a < b <!-- no --> c <3 <?x?>d</>", "a < b c <3 d"),
        ("<textarea><b>x</b></textarea>", "<b>x</b>"),
        ("<div>a<div>b</div></div>c", "a\nb\nc"),
        ("</p>x<td>y", "xy"),
        ("", ""),
        (None, ""),
        ("<body>a</body></html>tail", "atail"),
    ],
)
def test_layout(page, text):
    assert render(page)[0] == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td>a</td></tr><p>note</p></table>", "note\n\na"),
        ("<table><tr><td>a</td></tr><b>Total</b></table>", "Total\n\na"),
        ("<table><tbody><div>text</div><tr><td>a</table>z", "text\n\na\n\nz"),
        ("<table><tr><td>a</td></tr><form>Name <input value=v></form><tr><td>b</table>", "Name v\n\na\nb"),
        ("<table><tbody><tr><td>a<thead><i>x</i><tr><th>h</table>", "x\n\nh\na"),
        ("<table><tr><td>a</td><form><td>b</td></form></tr></table>", "a  b"),
        ("<table><tr><td>a</td><i>n<td>b</table>", "n\n\na  b"),
        ("<table><tbody><table><tr><td>x</table>", "x"),
        ("p<table><tr><td>a<table><tr><td>in</td></tr><b>n</b></table></table>", "p\n\nan\n\nin"),
    ],
)
def test_between_rows(page, text):
    assert render(page)[0] == text


@pytest.mark.parametrize("page", ["<" * 3000, "<div>" * 5000 + "x", "<table>" * 3000 + "y", "<a href='" * 2000, "<!--", "<tr><td>" * 500, "<li>" * 4000 + "z", "<table><tr>" * 400 + "q", "<b " + "'" * 5000, "<svg><title>", "<p" * 900, "<table><td colspan=99999 rowspan=0>x<td>y", "\x00<\x00>"])
def test_any_text_renders(page):
    render(page)


def test_wide_cells_pad_little():
    text = render("<table>" + f"<tr><td>{'x' * 5000}<td>a" + "<tr><td>b<td>c" * 50 + "</table>")[0]
    assert len(text) < 12_000 and "b  c" in text


def test_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in op10_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        assert got[k].text == render(page)[0] and "<p>" not in got[k].text and "track(" not in got[k].text and got[k].n_items == page.count("<li>")


def test_odd_rows(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, "b", None), (2, None, None), (3, "<p>" + "long " * 60_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(len(r.text) for r in extract(pages).collect()) == [0, 1, 1, 1, 299_999]
    assert extract(pages.limit(0)).count() == 0


def test_depth_has_no_limit():
    """Hidden blocks, text areas and lists are what they are at any depth, and deep pages take no deep recursion."""
    for deep in ("<div>" * 40_000, "<i>" * 40_000, "<blockquote>" * 400, "<ul><li>" * 400, "<table><tr><td>" * 400):
        text = render(f"{deep}<b style='display:none'>no</b><textarea>kept</textarea><p>end")[0]
        assert "no" not in text.split() and text.split()[-2:] == ["kept", "end"]
    assert render("<p>" + "<span>" * 3000 + "<div></div>" * 3000 + "x")[0] == "x"
    assert render("<p><button>" + "<i>" * 20_000 + "<div></div>" * 20_000 + "x")[0] == "x"


def test_wide_cells_are_wrapped_and_aligned():
    words = " ".join(f"word{k}" for k in range(40))
    lines = render(f"<table><tr><td>{words}<td>side<tr><td>b<td>c</table>")[0].split("\n")
    at = lines[0].index("side")
    assert at <= 82 and lines[-1].index("c") == at and " ".join(" ".join(lines).replace("side", "").split()[:-2]) == words


class Words(HTMLParser):
    """Visible words of a page whose tags are all closed, by the library's own parser."""

    VOID = {"br", "hr", "img", "input", "link", "meta"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.open.append((tag, tag in ("head", "script", "style", "template", "title") or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "").replace(" ", "")))

    def handle_endtag(self, tag):
        while self.open and any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.words += data.split()


def test_visible_words_against_another_parser(spark, sf):
    """Of the test data's pages, all visible words come out; marks of lists are the only others."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want, got = Counter("".join(Words(r.html).words)), Counter("".join(render(r.html)[0].split()))
        assert not want - got and set(got - want) <= set("•◦▪.0123456789"), r.page_id


@pytest.mark.parametrize("seed", range(5))
def test_generated_pages(seed):
    """Blocks made beside the text they should give, in HTML that leaves out what may be left out."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "b", "gamma delta", "x&amp;y", "é"])
    shown = lambda s: s.replace("&amp;", "&")
    for _ in range(60):
        page, blocks = "", []
        for _ in range(rnd.randint(1, 6)):
            kind = rnd.choice(["p", "h2", "ul", "ol", "table", "gone"])
            if kind in ("p", "h2"):
                w = word()
                page += f"<{kind}>{rnd.choice(['', '  '])}{w}" + (f"</{kind}>" if kind == "h2" or rnd.random() < 0.5 else "\n")
                blocks.append(shown(w))
            elif kind in ("ul", "ol"):
                items = [word() for _ in range(rnd.randint(1, 4))]
                page += f"<{kind}>" + "".join(f"<li>{w}" + rnd.choice(["", "</li>\n"]) for w in items) + f"</{kind}>"
                blocks.append("\n".join((f"{k}. " if kind == "ol" else "• ") + shown(w) for k, w in enumerate(items, 1)))
            elif kind == "table":
                grid = [[word() for _ in range(3)] for _ in range(rnd.randint(1, 3))]
                page += "<table>" + "".join("<tr>" + "".join(f"<td>{w}" for w in row) for row in grid) + "</table>"
                grid = [[shown(w) for w in row] for row in grid]
                wide = [max(len(row[c]) for row in grid) for c in range(3)]
                blocks.append("\n".join("  ".join(w.ljust(wide[c]) for c, w in enumerate(row)).rstrip() for row in grid))
            else:
                page += rnd.choice(["<p hidden>no</p>", "<script>no<p></script>", "<div style='display: none'>no<ul><li>no</ul></div>"])
        assert render(page)[0] == "\n\n".join(blocks), page
