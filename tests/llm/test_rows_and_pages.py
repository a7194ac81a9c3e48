"""Repeated ids in training rows, columns of odd names, broken and syndicated pages."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from geolith.llm import bpe, html_text, language_id, line_dedup, quality

VOCABULARY = "byte_bpe_50k.json"


def text_of(page, template=frozenset()):
    root = html_text.parse(page)
    html_text.digests(root)
    return html_text.extract(root, template)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main>One <svg/> two</main><p>three", "One two"), ('<main>One <svg class="x"><text>no</text></svg> two</main>', "One two"), ("x <math><mi>a</mi><mo>+</mo></math> y", "x a+ y"),
        ("<form><article>Story here</article></form>", "Story here"), ("<p class=it's>Hello</p>", "Hello"), ('<p title=5">Hello', "Hello"), ('<p title="a>b">Hello', "Hello"), ("<p title='a>b'>Hello", "Hello"),
        ('<main><p class="social media">We study this</p><p class="social">no</p></main>', "We study this"), ("a < b & c &amp; d <", "a < b & c & d <"), ("<p>one<p>two<!-- c --> three<!--> four<? x ?>five</ x>six<p", "one two three fourfivesix"),
        ("<ul><li>a<li>b</ul>", "a b"), ("<article>a<script>x<p>y</script>b</article>", "a b"), ("<article>a<script>if (x</scripts>1) y", "a"), ("<article>a<!-- b", "a"), (None, ""), ("", ""), ("<", "<"), ("<a", ""), ("</", "</"[:0]),
        ("<form><input></form><div>text that stays</div>", "text that stays"), ("<article><header>Title</header>Body</article>", "Title Body"),
    ],
)
def test_pages_by_the_standard(page, text):
    assert text_of(page) == text


def test_broken_pages_take_no_longer():
    for page in ("<a " * 350_000, "<b>" * 30_000 + "</i>" * 30_000, '<a x="' * 100_000, "<script>" * 100_000, "<!--" * 100_000, "<li>" * 50_000, "<" * 500_000, "&" * 500_000):
        began = time.perf_counter()
        text_of(page)
        assert time.perf_counter() - began < 5, page[:9]


def test_a_story_that_many_pages_print_is_no_template(spark):
    story = "".join(f"<p>Paragraph {i} of a story that eight papers of one publisher print word for word.</p>" for i in range(6))
    notice = '<div class="x1">All rights belong to the publisher of this site.</div>'
    pages = [(i, f"http://a.example/{i}", f"<main><p>Printed on day {i}</p>{story}{notice}</main>") for i in range(8)]
    pages += [(i, f"http://a.example/{i}", f"<main><p>Page {i} has its own words about thing number {i}, at some length as well.</p>{notice}</main>") for i in range(8, 108)]
    pages += [(200 + i, f"http://d.example/{i}", f"<main><p>Printed on day {i}</p><p>A short story that is told here.</p></main>") for i in range(10)]
    pages += [(i, f"http://b.example/{i}", f"<article><h1>Day {i}</h1><div>{story}</div></article>") for i in range(108, 120)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in (0, 7, 110):
        assert all(f"Paragraph {k} of a story" in got[i] for k in range(6))
    assert got[203] == "Printed on day 3 A short story that is told here."
    assert "All rights" not in got[50] and "Page 50 has its own words" in got[50]


def test_templates_decide_what_has_no_name(spark):
    """Menus in plain elements whose entries differ, and a notice that recurs; without templates both would be read."""
    menu = lambda i: '<div class="q7">' + "".join(f'<span><a href="/{i}/{k}">Entry {i * 31 + k}</a></span>' for k in range(5 + i % 3)) + "</div>"
    body = lambda i: f"<div><p>Body of page {i}, in words of its own, with a <a href='#'>link</a>.</p></div>"
    pages = [(i, f"https://c.example/{i}", f"<body>{menu(i)}<div>Call us at any hour</div>{body(i)}</body>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"a.b": F.lit(1), "text": F.lit("clash"), "template": F.lit("x")})
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got == {i: f"Body of page {i}, in words of its own, with a link." for i in range(40)}
    assert all("Entry" in text_of(page) and "Call us" in text_of(page) for _, _, page in pages)


def test_training_rows_of_repeated_ids(spark):
    one, two = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(one, f"the house and the garden number {i}", "en", 1) for i in range(50)] + [(one, "das Haus und der Garten hier", None, 1)] * 50
    rows += [(two, f"das Haus und der Garten {i}", "de", 2) for i in range(40)] + [(two, "das Haus", "de", 2)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int").repartition(6)
    model = language_id.fit(df, per_language=30)
    found = {r.text: r["__lang"] for r in language_id.predict(df, model).collect()}
    assert found["das Haus und der Garten hier"] == "de" and found["the house and the garden number 7"] == "en"


def test_labels_of_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"words {i} " * (1 + i % 7), 1) for i in range(2000)], "doc_id long, text string, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(40)], "doc_id long, quality int")
    seen = []
    fit_rules = quality.fit_rules
    try:
        quality.fit_rules = lambda x, y: seen.append(len(y)) or fit_rules(x, y)
        model = quality.fit(docs, labels, most_rows=100)
    finally:
        quality.fit_rules = fit_rules
    assert seen == [100]
    assert quality.score(docs, model).columns == ["doc_id", "text", "a.b", "__score"]


def test_columns_with_dots(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "one line that is long\nanother", 7), (2, "one line that is long", 8)], "doc_id long, text string, `a.b` int")
    out = line_dedup.line_dedup(df)
    assert {r.doc_id: (r["a.b"], r.text) for r in out.collect()} == {1: (7, "one line that is long\nanother"), 2: (8, "")}
    encoded = bpe.encode(df, public_tokenizers.path(VOCABULARY))
    assert {r["a.b"]: r.text for r in bpe.decode(encoded, public_tokenizers.path(VOCABULARY)).collect()} == {7: "one line that is long\nanother", 8: "one line that is long"}
