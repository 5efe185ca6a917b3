import time

import pytest

from saffron.llm import html_text

DEEP = 20_000


@pytest.mark.parametrize("broken", ["<a ", "<a '>' ", '<a "', "</script ", "<!-- ", "<b>", "<div>", "<td>", "</i>", "<p><i>", "<a b='", "&amp"])
def test_long_broken_pages_take_linear_time(broken):
    began = time.process_time()
    html_text.render(broken * (1_000_000 // len(broken)))
    html_text.render("<script>" + broken * (1_000_000 // len(broken)))
    assert time.process_time() - began < 60


HOSTILE = {
    "colspans": "<table><tr>" + "<td colspan=1000>x" * 55_000,
    "stray ends": "<b>" * 150_000 + "</i>" * 130_000,
    "rules in an open stack": "<p><td>" + "<b>" * 180_000 + "<hr>" * 120_000,
    "cells": "<table><tr>" + "<td>x" * 100_000,
    "stairs": "<table>" + "<tr><td rowspan=65534>x" * 43_000,
    "a tall cell": "<table><tr>" + "<td>x" * 20_000 + "<td>" + "y<br>" * 20_000,
    "lists": "<ul><li>x" * 110_000,
    "empty lists": "<ul><li>" * 120_000 + "x",
    "tables": "<table><tr><td>a<td>b" * 45_000,
    "quotes": "<blockquote>x" * 70_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_cost_and_give_little(name):
    page = HOSTILE[name]
    began = time.process_time()
    text = html_text.render(page)
    assert time.process_time() - began < 20 and len(text) < 16 * len(page) + html_text.ROOM
    for letter in "xyab":
        shown = page.replace("<table", "").replace("<blockquote", "").replace("<b>", "").replace("<br>", "")
        if f">{letter}" in shown:
            assert text.count(letter) == shown.count(f">{letter}") + (letter == "y") * 19_999 * (name == "a tall cell")


@pytest.mark.parametrize(
    "page, text",
    [
        ("<!--x--!>visible text", "visible text"),
        ("a<!-->b-->c", "ab-->c"),
        ("a<!--->b<!---->c<!-- - -- > -->d<!--", "abcd"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
        ("<div style='visibility:hidden;visibility:visible'>yes</div><p style='display:none'><b style='visibility:visible'>no</b>", "yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<table><tr><td>\u65e5\u672c<td>a<tr><td>abcd<td>b<tr><td>e\u0301<td>c</table>", "\u65e5\u672c  a\nabcd  b\ne\u0301     c"),
        ("<ul><li><p>a<p>b<ul><li>c</ul><li><ol start=9><li>d<li><li>e</ol></ul>", "- a\n\n  b\n\n  - c\n- 9. d\n  11. e"),
        ("<ul><li></ul>x<blockquote><p>q<p>r</blockquote>y", "x\n\n  q\n\n  r\n\ny"),
        ("<pre>a\n  b</pre><dl><dt>t<dd>d<dd><pre>x\n y</pre></dl>", "a\n  b\n\nt\n  d\n  x\n   y"),
    ],
)
def test_comments_visibility_width_and_indents(page, text):
    assert html_text.render(page) == text


def test_depth_changes_nothing():
    assert html_text.render("<div>" * DEEP + "<div hidden>SECRET</div>seen") == "seen"
    assert html_text.render("<span>" * DEEP + "<ul><li>a<li>b</ul>") == "- a\n- b"
    assert html_text.render("<div>" * DEEP + "<table><tr><td>a<td>b<tr><td>long<td>c</table>") == "a     b\nlong  c"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><td colspan=2>a wide cell here<td>x<tr><td>1<td>2<td>3</table>", "a wide cell here  x\n1  2              3"),
        ("<table><tr><td rowspan=2>tall<td>1<tr><td>2<tr><td>a<td>b</table>", "tall  1\n      2\na     b"),
        ("<table><tr><td colspan=1000>title<tr><td>a<td>b</table>", "title\na  b"),
        ("<table><tr><td colspan=x rowspan=0>a<td>b</table>", "a  b"),
        ("a < b <c", "a < b <c"),
        ("<a title='x > y'>t</a>", "t"),
    ],
)
def test_cells_that_span_and_loose_marks(page, text):
    assert html_text.render(page) == text


def test_odd_tables(spark):
    rows = [(1, None), (1, ""), (2, "<p>x"), (2, "<p>x"), (None, "<b>y</b>"), (3, "\x00<p \x00>z")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'extra' AS text")
    out = html_text.visible_text(pages)
    assert out.columns == ["page_id", "text"]
    assert sorted(((r["page_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, ""), (1, ""), (2, "x"), (2, "x"), (None, "y"), (3, "\x00\n\nz")], key=str)
    assert html_text.visible_text(pages.where("false")).count() == 0
