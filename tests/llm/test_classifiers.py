"""Held-out accuracy and defined results of the learned operators, and the visible words of pages."""

from html.parser import HTMLParser

import pytest

from saffron.llm import html_text, langid, quality, toxicity
from saffron.llm.queries import QUERIES
from tests.conftest import MEDIUM, SMALL
from tests.llm.rows import docs


def test_languages_of_rows_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op6_language"](spark, MEDIUM).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.9 * len(rows) > 50


@pytest.mark.parametrize("name, label", [("op2_quality", "quality"), ("op10_toxicity", "toxic")])
def test_labels_of_rows_held_out(spark, name, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [(r["score"], truth[r["doc_id"]]) for r in QUERIES[name](spark, MEDIUM).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.75 * len(good) * len(bad) > 0  # area under the curve


def test_odd_rows(spark):
    df = docs(spark, clash=True)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(None, 1, 1), (3, None, 7)], "doc_id long, quality int, toxic int")
    for model, threshold in ((quality.learn(df, labels), 0.3), (toxicity.learn(df, labels), 0.5)):
        rows = quality.score(df, model, threshold).collect()
        assert len(rows) == df.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    for r in langid.predict(df, langid.learn(df)).collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 11):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert langid.accepted(df, langid.learn(df)).columns == df.columns
    empty = docs(spark, [])
    assert langid.learn(empty).langs == []
    assert quality.score(empty, quality.learn(empty, labels), 0.3).count() == 0
    assert {r["score"] for r in quality.score(df, quality.learn(df, labels.limit(0)), 0.3).collect()} == {0.5}


def test_offending_sentences_are_located():
    texts = [f"A calm line about tea number {i}. Another calm line." for i in range(60)] + [f"A calm line about tea number {i}. You vile scumbag! Another calm line." for i in range(60)]
    model = toxicity.fit(texts, [0] * 60 + [1] * 60)
    text = "Tea is calm. You vile scumbag! Another calm line."
    assert ["vile scumbag" in text[s:e] for s, e, _ in model.offending(text)] == [True]


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_no_visible_letter_of_a_page_is_lost(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    have = {r["page_id"]: r["text"] for r in html_text.visible_text(pages).collect()}
    letters = lambda t: sorted(c for c in t if c.isalnum())
    whole = 0
    for r in pages.collect():
        parser = Words()
        parser.feed(r["html"] or "")
        whole += letters("".join(parser.parts)) == letters(have[r["page_id"]]) or "hidden" in r["html"] or "none" in r["html"] or "<noscript" in r["html"]
    assert whole == pages.count()


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n\n  1. z"), ("a<!-- b -->c", "ac"), ("<div hidden>x</div>y", "y"), ("<p style='display: none'>x</p>y", "y"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;b&gt; &amp; c", "<b> & c"), ("<script>x</script>z</p></div>", "z"),
    ],
)
def test_rendering(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><p>x</body></html>", "x"), ("<html><title>t</title><meta charset=utf-8><p>x", "x"), ("<head><style>s</style>\n<p>x", "x"), ("<head><title>t</title> words<p>x", "words\n\nx"),
        ("<head><script>s</script></body>x", "x"), ("<head><template><p>no</p></template><div>x", "x"), ("<head><title>t</title></head>x", "x"), ("x<head>y<p>z", "xy\n\nz"),
    ],
)
def test_a_head_ends_without_its_end_tag(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("a <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math> b", "a x+1 b"), ("<p>a<svg width=5 /><p>b", "a\n\nb"), ("<div><math/>x</div>", "x"), ("<svg a=b/><text>t</text></svg>x", "t\nx"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs>no<g><text>one <tspan>two</tspan></text><text>three</text></g></svg>", "one two\nthree"), ("<svg><text display='none'>no</text><style>a>b</style></svg>x", "x"),
        ("<svg><g><p>x", "x"), ("<svg><foreignObject><p>x</p></foreignObject></svg>", "x"), ("<math><mtext><![CDATA[no]]>y</mtext><ms><b>z</b></ms></math>", "yz"), ("<svg><text><![CDATA[a<b]]></text></svg>", "a<b"),
        ("<p>Pick <select><option>A<option selected>B</select> now", "Pick\nA\nB\nnow"), ("<select><optgroup label='G &amp; H'><option label=L>no<optgroup label=I><option>C</select>", "G & H\nL\nI\nC"),
        ("a<textarea>\n <b>x</b>\n  &amp; y</textarea>b", "a\n <b>x</b>\n  & y\nb"), ("<textarea hidden>no</textarea>x", "x"),
        *[(f"a<{t}>no</{t}>b", "ab") for t in ("script", "style", "title", "template", "noscript", "iframe", "object", "audio", "video", "canvas", "datalist")], ("a<b style='visibility:hidden'>no</b>b", "ab"), ("a<link href=no><meta content=no>b", "ab"),
    ],
)
def test_what_a_browser_shows_is_kept_and_the_rest_is_not(page, text):
    assert html_text.render(page) == text
