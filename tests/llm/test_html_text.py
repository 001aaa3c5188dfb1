"""Layout rules by example, and the whole pages table against a plain word check."""
import html.parser
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pliego.llm import html_text as H

CASES = [
    ("a<p>b<p>c", "a\n\nb\n\nc"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("  a \n b&nbsp;c&amp;&lt;x&gt; ", "a b c&<x>"),
    ("<b>a</b><i>b</i> <u> c</u>", "ab c"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<ol><li>a<br>b</ol>", "1. a\n   b"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><td>x<td>y</table>", "x  y"),
    ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a<script>if (a<b) {}</script>b<!-- c --><style>p{}</style>", "ab"),
    ("<p hidden>x<p style='display: none'>y<p aria-hidden=true>z<p>w", "w"),
    ("<style>.n, #i{display:none} p.m{visibility:hidden}</style><p class='n k'>x<p id=i>y<p class=m>z<div class=m>w", "w"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<details><summary>s</summary>x</details><details open>y</details>", "s\ny"),
    ("a<br><br>b", "a\n\nb"),
    ("<blockquote>q</blockquote>", "    q"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("<img alt='pic'> x <input value=v>", "pic x"),
    ("a</p>b</div></b>c", "a\n\nbc"),
    ("x < y <3 a<", "x < y <3 a<"),
    ("<p", ""), ("<!-- open", ""), ("<a href='>'>t</a>", "t"), ("<select><option>a<option>b</select>", "a\nb"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_rules(source, want):
    assert H.html_to_text(source) == want


def test_deep_and_long_pages():
    assert H.html_to_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert H.html_to_text("<p>word" * 20000).count("word") == 20000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "a", " ", "<", "&amp", "<pre>", "<!--", "-->", "\"", ">"]), max_size=25))
def test_any_markup(parts):
    H.html_to_text("".join(parts))


class Plain(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_whole_table_shows_all_words(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    got = {r.page_id: r.text for r in QUERIES["op3_html_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        parser = Plain()
        parser.feed(p.html)
        text = got[p.page_id]
        shown = re.sub(r"(?m)^ *(?:- |\d+\. )", "", text)
        want = "".join("".join(parser.words).split())
        if not re.search("hidden|display:none", p.html):
            assert "".join(shown.split()) == want, p.page_id


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "<p>a", 3), (3, "<p>a", 3), (None, "b", 4)]
    df = spark.createDataFrame(rows, "page_id long, html string, Text int")
    out = H.extract_text(df)
    assert out.columns == ["page_id", "html", "text"]
    assert sorted((r.page_id or 0, r.text or "") for r in out.collect()) == [(0, "b"), (1, ""), (2, ""), (3, "a"), (3, "a")]
    assert H.extract_text(df.limit(0)).count() == 0


X = "<p class=x>x</p>w"
SHEETS = [
    ("@media print{.x{display:none}}", "x\n\nw"), ("@media print{body{display:none}} p{color:red}", "x\n\nw"),
    ("@media (max-width:600px){.x{display:none}}", "x\n\nw"), ("@media(min-width:600px){.x{display:none}}", "w"),
    ("@media screen and (min-width: 40em), print{.x{display:none}}", "w"), ("@media not print{.x{display:none}}", "w"),
    ("@media (unheard-of){.x{display:none}}", "x\n\nw"), ("@media screen{@media print{.x{display:none}}}", "x\n\nw"),
    ("@media screen{\n.x{display:none}} .y{color:red}", "w"), ("@import 'a;{b'; .x{display:none", "w"),
    (".x{display:none} .x{display:block}", "x\n\nw"), (".x{display:block} p{display:none}", "x\n\nw"),
    (".x{display:none!important} p.x{display:block}", "w"), (".x{display:none;display:block}", "x\n\nw"),
    (".q{content:'}'} .x{visibility:hidden}", "w"), ("b{.x{display:none}}", "x\n\nw"), ("@supports (display:grid){.x{display:none}}", "w"),
]


@pytest.mark.parametrize("sheet,want", SHEETS)
def test_style_sheets(sheet, want):
    assert H.html_to_text(f"<style>{sheet}</style>{X}") == want


def test_all_visible_text(spark):
    pages = [("<style media=print>.x{display:none}</style>" + X, "x\n\nw"), ("<style>.x{display:none}</style><p class=x style='display:block'>x</p>w", "x\n\nw"),
             ("<p aria-hidden=true>x</p>w", "x\n\nw"), ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>t</annotation></math> b", "a x=1 b"),
             ("<svg><title>t</title><desc>d</desc><defs><text>e</text></defs><path/><text>f</text><text>g</text></svg>h", "f\ng\nh"),
             ("<svg><defs/><text>f</text></svg>", "f")]
    got = H.extract_text(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "page_id long, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: t for i, (_, t) in enumerate(pages)}


def test_deeply_nested_tables():
    assert H.html_to_text("<table><tr><td>" * 5000 + "x" + "</table>" * 5000 + "y") == "x\n\ny"
    assert H.html_to_text("<table><td>a" * 500).split() == ["a"] * 500
    assert H.html_to_text("<table><td>" * 5000 + "x") == "x"
