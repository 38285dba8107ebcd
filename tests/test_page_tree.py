"""Elements and fields of a page by nesting."""

import time

from pyspark.sql import functions as F

from newsloom.functions import page_tree as P
from newsloom.operators import crawl

LONG = "A sentence that is long enough to be a paragraph of the plain layout"


def texts(page, name):
    return [e.text for e in P.elements(page) if e.name == name]


def test_an_element_ends_at_its_own_closing_tag():
    page = '<div data-testid="dek-block">a<div>b<div>c</div></div>d</div>e'
    assert texts(page, "div") == ["abcd"]


def test_paragraphs_end_at_blocks_and_with_the_page():
    assert texts("<p>one<p>two<div>three</div></p><p>four", "p") == ["one", "two", "four"]
    assert texts("<p>cell<table><tr><td><p>inner</p></td></tr></table>", "p") == ["cell", "inner"]
    assert texts("<p><button><div>kept</div></button> inside</p>", "p") == ["kept inside"]


def test_stray_closing_tags_and_signs_are_passed_over():
    assert texts("</div><p>1 < 2 &amp; 3 &#8212; &#x41;<br>next</span></p>", "p") == ["1 < 2 & 3 — A\nnext"]
    assert P.elements("") == [] and texts("<p", "p") == []


def test_layouts_fall_back_in_order():
    plain = "".join(f"<p>{LONG} {k}</p>" for k in range(4))
    marks = [f'<div data-testid="paragraph">{LONG} m{k}</div>' for k in range(3)]
    marked, few = "".join(marks), "".join(marks[:2])
    typed = "".join(f"<p data-type='paragraph'>{LONG} t{k}</p>" for k in range(3))
    assert P.fields(f"<article>{marked}{typed}{plain}</article>")[5:7] == (1, 3)
    assert P.fields(f"<article>{few}{typed}{plain}</article>")[5:7] == (2, 3)
    assert P.fields(f"<article>{plain}<p>Write to {LONG}</p></article><p>{LONG}</p><article><p>{LONG}</p></article>")[5:7] == (3, 4)
    assert P.fields(None) == ("", "", "", "", "", 3, 0, False)


def test_headline_and_time_come_from_marks_first():
    page = '<h1>Site</h1><time>now</time><b data-testid="headline">H <i>x</i></b><i data-testid="byline">by A B</i>'
    assert P.fields(page)[:4] == ("H x", "", "A B", "now")


def test_deep_and_broken_pages_take_linear_time():
    start = time.time()
    for page in ("<div>" * 200_000, "<p>" * 200_000, "<a " * 200_000, "<div><p>" * 50_000 + "</div>" * 50_000):
        P.fields(page)
    assert time.time() - start < 20


def test_null_empty_and_repeated_pages(spark):
    page = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(3)) + "</article>"
    rows = [(1, "https://example.com/a/b/", page), (1, "https://example.com/a/b/", page), (2, None, None), (3, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = crawl.extract_articles(pages).collect()
    assert [r["page_id"] for r in got] == [1, 1] and got[0]["content"].count(LONG) == 3
    assert crawl.extract_articles(pages.filter("false")).isEmpty()


def test_profiles_group_without_rereading_the_page(spark):
    pages = spark.createDataFrame([(1, '<p class="a"><p class="b"><p class="a">'), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, crawl.attribute_profile(pages, "class").collect())) == [(1, "a", 2), (1, "b", 1)]
    assert [tuple(r) for r in crawl.tag_profile(pages).select(F.col("page_id"), "tag", "n").collect()] == [(1, "p", 3)]
