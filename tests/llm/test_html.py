import html
import random
import re
import time

import pytest

from cadenza.llm import html_text
from cadenza.llm.html_text import visible_text

CASES = {
    "blocks": ("<p>One <b>two</b>\n three<p>Four<div>Five</div><div>Six</div>", "One two three\n\nFour\n\nFive\nSix"),
    "misnested": ("<p><b>bold<br><p>next</p></b> tail", "bold\n\nnext\n\ntail"),
    "unseen": ("<title>t</title><style>p{margin:0}</style><script>var t='</p>';</script><p>a<template>x</template><noscript>n</noscript></p><!-- c -->b", "a\n\nb"),
    "hidden": ('<p hidden>a</p><p style="color:red; display : none">b</p><p style="visibility:hidden">c</p><p>d</p><dialog>e</dialog>', "d"),
    "style sheet": ("<style>.ad, #x, b.y {display:none} @media print { p {display:none} }</style><p>a</p><p class='big ad'>b</p><p id=x>c</p><b class=y>d</b><i class=y>e</i>", "a\n\ne"),
    "list": ("<p>x</p><ul><li>a<li>b<ol start=3><li>c<li value=9>d<li>e</ol><li>f</ul>y", "x\n\n- a\n- b\n  3. c\n  9. d\n  10. e\n- f\n\ny"),
    "definitions": ("<dl><dt>t<dd>long<dt>u<dd>v</dl>", "t\n  long\nu\n  v"),
    "pre": ("<pre>a  b\n c</pre>d  e", "a  b\n c\n\nd e"),
    "table": ("<table><tr><th>name<th>n<tr><td>alpha<td>1<tr><td>b<td>22</table>z", "name  | n\nalpha | 1\nb     | 22\n\nz"),
    "spans": ("<table><tr><td colspan=2>wide<td>c<tr><td rowspan=2>r<td>x<td>y<tr><td>p<td>q</table>", "wide  | c\nr | x | y\n  | p | q"),
    "cells of lines": ("<table><tr><td>a<br>bb<td>c<tr><td>d<td><ul><li>e<li>f</ul></table>", "a  | c\nbb |\nd  | - e\n   | - f"),
    "nested table": ("<table><tr><td>a<td><table><tr><td>x<td>y</table><tr><td>bbb<td>c</table>", "a   | x | y\nbbb | c"),
    "text in a table": ("<table>loose<tr><td>a</table>", "loose\na"),
    "entities": ("a&amp;b &lt;i&gt; x&nbsp;&nbsp;y &#233; &bogus;", "a&b <i> x  y é &bogus;"),
    "inline space": ("<span>a</span> <span>b</span><span> c</span>", "a b c"),
    "details": ("<details><summary>s</summary>body</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    "after the end": ("<html><body>a</body></html> b", "a b"),
    "broken": ("<<p>>x</ </p></div>", "<\n\n>x"),
    "empty": ("", ""),
    "wide characters": ("<table><tr><td>日本<td>a<tr><td>xyz<td>b</table>", "日本 | a\nxyz  | b"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    source, want = CASES[name]
    assert visible_text(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<head><title>t</title><font>all the text<br>more</font>", "all the text\nmore"),
        ("<html><head><meta charset=x><a href=y>link</a> and <b>bold</b>", "link and bold"),
        ("<head><script>x</script><noscript><img></noscript><link rel=a><style>p{}</style></head><p>a", "a"),
        ("<head><template><b>no</b></template><title>t</title></head>a", "a"),
        ("<head><style media=print>p {display:none}</style></head><p>a", "a"),
        ("<style media='screen, print'>p {display:none}</style><p>a</p>b", "b"),
        ("<style media='not screen'>p {display:none}</style><p>a", "a"),
        ("<style media='only screen and (min-width: 1px)'>p {display:none}</style><p>a</p>b", "b"),
        ("<style media='(min-width: 1px)'>p {display:none}</style><p>a</p>b", "b"),
    ],
)
def test_all_visible_text_after_an_open_head_or_a_sheet_for_print(source, want):
    assert visible_text(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("<style>p{display:none} p{display:block}</style><p>a", "a"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
        ("<style>.x{display:none !important}</style><p class=x style='display:block'>a</p>b", "b"),
        ("<p style='display:none;display:block'>a", "a"),
        ("<p style='display:none;display:nonsense'>a</p>b", "b"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"),
        ("<div style='display:none'>a<b style='display:block;visibility:visible'>b</b></div>c", "c"),
        ("<style>#m .x > b{display:none}</style><div id=m><p class=x><b>a</b><i><b>c</b></i></p></div><p class=x><b>d</b>", "c\n\nd"),
        ("<style>p.x{display:none} p{display:block}</style><p class=x>a</p>b", "b"),
        ("<style>[data-k=v]{display:none} a:hover{display:none}</style><i data-k=v>a</i><i data-k=w>b</i><a>c</a>", "bc"),
        ("<style>@media screen{.s{display:none}} @media (max-width:9px){.t{display:none}} @import 'x'; .u{display:none}</style><i class=s>a</i><i class=t>b</i><i class=u>c</i>", "b"),
        ("<style>.h{display:block}</style><p hidden class=h>a", "a"),
        ("<p>x <svg><desc>no</desc><path d=1 /><text>one</text><text>two</text></svg> y <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math>", "x\none\ntwo\ny a+b"),
        ("<style>li.q{visibility:hidden}</style><ul><li>a<li class=q>b<li>c</ul>", "- a\n- c"),
    ],
)
def test_cascade(source, want):
    assert visible_text(source) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ('<span style="display:block">a</span><span style="display:block">b</span>', "a\nb"),
        ("<style>.r{display:flex}</style>x<i class=r>a</i>y", "x\na\ny"),
        ("<ul><li style='display:inline'>a<li style='display:inline'>b</ul>", "ab"),
        ("<ul><li style='display:block'>a<li>b</ul>", "a\n- b"),
        ("<div style='display:inline'>a</div><div style='display:inline'>b</div>", "ab"),
        ("<div style='display:inline-block'>a</div> <div style='display:contents'>b</div>", "a b"),
        ("<b style='display:list-item'>a</b><b style='display:list-item'>b</b>", "- a\n- b"),
        ("<table style='display:list-item'><tr style='display:list-item'><td>a<td>b<tr><td>c</table>", "a | b\nc"),
        ("x<input type=submit value=go>y<input type=BUTTON value='a b'><input type=reset><input type=text value=no><input type=hidden value=no>", "xgoya b"),
        ("<p hidden>a<input type=submit value=go></p>b", "b"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"),
        ("<ol type=a start=26><li>a<li>b</ol><ol type=I start=1989><li>c<li type=i>d</ol>", "z. a\naa. b\n\nMCMLXXXIX. c\nmcmxc. d"),
        ("<style>p:not(.x){display:none}</style><p>a<p class=x>b", "b"),
        ("<style>p:not(.x):not(#y) > b:not([k]){display:none} p.x:not(b) {visibility:hidden}</style><p>a<b>c</b><b k>d</b><p class=x>b", "ad"),
        ("<style>@media (max-width: 600px){p{display:none}} @media (min-width: 40em) and (orientation: landscape){i{display:none}}</style><p>a</p><i>b</i>", "a"),
        ("<style media='(max-width: 600px)'>p{display:none}</style><style media='(min-width: 40em), print'>i{display:none}</style><p>a</p><i>b</i>", "a"),
        ("<style>@media (prefers-color-scheme: dark){p{display:none}} @media screen and (some-day){p{display:none}} @media not print{b{display:none}}</style><p>a<b>b", "a"),
    ],
)
def test_display_lists_and_media(source, want):
    assert html_text.visible_text(source) == want


def test_tables_against_a_grid_of_squares():
    """Rows of cells put square by square; a cell's text must begin at one place in all lines for each first column."""
    rng = random.Random(11)
    for _ in range(200):
        rows, taken, texts = [], set(), {}
        source, n = "<table>", 0
        height = rng.randint(1, 5)
        for r in range(height):
            source += "<tr>"
            column = 0
            for _ in range(rng.randint(1, 4)):
                while (r, column) in taken:
                    column += 1
                wide, tall = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])
                texts[n] = (r, column)
                source += f"<td colspan={wide} rowspan={tall}>c{n}q{'x' * rng.randint(0, 9)}"
                taken |= {(r + i, column + k) for i in range(tall) for k in range(wide)}
                column += wide
                n += 1
        places: dict[int, set[int]] = {}
        lines = html_text.visible_text(source + "</table>").split("\n")
        assert len(lines) == height
        for k, (r, column) in texts.items():
            places.setdefault(column, set()).add(lines[r].index(f"c{k}q"))
        assert all(len(x) == 1 for x in places.values())
        starts = [min(places[c]) for c in sorted(places)]
        assert starts == sorted(set(starts))


def test_blowup_is_a_parameter():
    source = "<table>" + "<tr><td>a<td>b" * 50 + f"<tr><td>{'x' * 3000}<td>c</table>"
    near, far = (html_text.visible_text(source, k).split("\n") for k in (1, 10_000))
    assert near[0] == "a | b" and far[0] == "a" + " " * 2999 + " | b"
    assert near[-1] == far[-1] == "x" * 3000 + " | c"


def test_many_rules_and_wide_spans():
    began = time.process_time()
    rules = "".join(f".c{i}{{display:none}}" for i in range(3_000))
    page = f"<style>{rules}</style>" + "".join(f"<b class=k{i % 50}>x</b>" for i in range(20_000))
    assert visible_text(page) == "x" * 20_000
    cells = "<tr>" + "<td colspan=1000 rowspan=65534>x" * 50
    assert visible_text(f"<table>{cells * 1_000}</table>").count("x") == 50_000
    assert time.process_time() - began < 6


def test_long_cells_stay_in_columns():
    long = "w" * 200
    assert visible_text(f"<table><tr><td>{long}<td>a<tr><td>b<td>c</table>") == f"{long} | a\nb{' ' * 199} | c"


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert visible_text("<ul><li>" * 300 + "x").strip().endswith("x")
    rows = "<tr><td>a<td>" + "w " * 50_000 + "<td>b" + "<tr><td>c<td>d<td>e" * 2_000
    assert len(visible_text(f"<table>{rows}</table>")) < 1_000_000  # a long cell doesn't widen every row
    assert visible_text("<p>a" * 20_000).count("a") == 20_000


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.op2_html_text(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:  # plain pages: what is left without head, comments and tags, in order
        plain = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", " ", r["html"])
        plain = html.unescape(re.sub(r"<li>", " - ", re.sub(r"</?(?!li>)[a-zA-Z!][^>]*>", " ", plain)).replace("</li>", " "))
        assert got[r["page_id"]].split() == plain.split()


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "<p>x", "c"), (3, "<p>y", "d"), (3, "<p>y", "d"), (4, "<b>" + "long " * 100_000, "e")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (None, "x"), (3, "y"), (3, "y"), (4, ("long " * 100_000).strip())], key=str)
    assert html_text.extract_text(df.limit(0)).collect() == []
