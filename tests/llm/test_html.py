"""Extraction from pages with known articles, on hosts with several layouts."""

import re

import pandas as pd

from tracelink.llm import html

FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def page(k: int, layout: str) -> tuple[str, str]:
    article = [f"Title {k}", *[" ".join(f"{w}{k}{i}" for w in FILLER) for i in range(4)]]
    body = "".join(f"<p>{p.replace('elit', '<b>elit</b>')}</p>\n" for p in article[1:])
    menu = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "About")) + "</ul>"
    if layout == "marked":
        out = f"<nav>{menu}</nav><article><h1>{article[0]}</h1>{body}<div class='x7'>Read more of our stories today</div></article><div class='comments'><p>nice {k}</p></div><footer>c</footer>"
    elif layout == "divs":
        out = f"<div class='top'>{menu}</div><div class='c12'><h1>{article[0]}</h1>{body}</div><div class='z9'><p>All rights are reserved by the owners of this site</p></div>"
    else:
        out = f"<div class='cookie-notice'>We use {k} cookies</div><div id='main-content'><h1>{article[0]}</h1>{body}<form><input><p>Sign up {k}</p></form></div><div class='sidebar'>side {k}</div>"
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{out}<script>var x = '<p>no</p>';</script></body></html>", " ".join(article)


def test_layouts(spark):
    rows, want = [], {}
    for layout in ("marked", "divs", "hints"):
        for k in range(6):
            text, article = page(k, layout)
            rows.append((len(rows), f"http://{layout}.example/{k}", text))
            want[len(rows) - 1] = article
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_classes_share_vectors(spark):
    rows = [(k, f"http://h.example/{k}", page(k, "divs")[0]) for k in range(5)]
    slots = html.deduce(spark.createDataFrame(rows, "page_id long, url string, html string")).first().slots
    assert len({s["class"] for s in slots}) == 1 and all(s["pages"] == 5 for s in slots)


def texts_of(spark, pages):
    rows = [(k, f"http://h.example/{k}", f"<html><body>{p}</body></html>") for k, p in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_articles_stay_where_most_pages_are_copies(spark):
    """Copies of an article in most of a host's slot, unmarked with a date apart and in an inner element of <article>."""
    articles = [" ".join(f"{w}{k}" for w in FILLER) for k in (0, 0, 0, 0, 0, 1, 2)]
    legal = "All rights are reserved by the owners of this site"
    got = texts_of(spark, [f"<div class='d'>day {k}</div><div class='c'><h1>T{a[-1]}</h1><p>{a}</p></div><div class='z'><p>{legal}</p></div>" for k, a in enumerate(articles)])
    assert got == {k: f"day {k} T{a[-1]} {a}" for k, a in enumerate(articles)}
    got = texts_of(spark, [f"<article><h1>day {k}</h1><div class='c'><p>{a}</p></div><div class='z'><p>{legal}</p></div></article>" for k, a in enumerate(articles)])
    assert got == {k: f"day {k} {a}" for k, a in enumerate(articles)}


def test_classes_decide(spark):
    """A line with the vector of the site's elements is of the template, at any depth; one in an element that comes with a single article is not."""
    bodies = [" ".join(f"{w}{k}" for w in FILLER) for k in range(6)]
    row = lambda k: "".join(f"<div class='r'><p>{x} line of the site</p></div>" for x in ("First", "Second"))
    got = texts_of(spark, [f"<div class='c'><p>{b}</p></div><div class='z'>{row(k)}</div>" for k, b in enumerate(bodies)])
    assert got == dict(enumerate(bodies))
    special = [f"<div class='c{' own' if k < 4 else ''}'><p>{bodies[0 if k < 4 else k]}</p></div><div class='y'>x {k}</div><div class='z'>{row(k)}</div>" for k in range(6)]
    assert texts_of(spark, special) == {k: f"{bodies[0 if k < 4 else k]} x {k}" for k in range(6)}


def test_pages_of_the_tables(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = html.extract_text(pages).toPandas().set_index("page_id")["text"]
    import html as entities

    for r in pd.read_parquet(f"{data}/pages.parquet").itertuples():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner).replace("<b>", "")).split())
        assert got[r.page_id] == want
