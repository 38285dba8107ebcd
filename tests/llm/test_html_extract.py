"""Main text of pages: hand-made pages against their known texts, and recounted templates."""

import collections
import html
import re

import pytest

from newsloom.llm import html_extract
from newsloom.llm.html_extract import Page, main_texts, op11_html_extraction

NONE = frozenset()


def text(source, template=NONE):
    return Page(source).main_text(template)[0]


@pytest.mark.parametrize("source, expected", [
    ("", ""),
    ("   \n ", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b<br>c", "a\nb c"),
    ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>x</footer>", "T\none\ntwo"),
    ("<p>1 &lt; 2 &#233;&nbsp;&eacute; <3</p>", "1 < 2 é é <3"),
    ("<article><p>in<b>li</b>ne</p>tail</article>", "inline\ntail"),
    ("<nav>menu</nav><header>top</header><article>x</article><aside>side</aside>", "x"),
    ("<body><div class='cookie-notice'>We use</div><p>text</p><form>mail</form></body>", "text"),
    ("<body class='has-sidebar'><div class=content><p>text</p></div><div id=sidebar>links</div></body>", "text"),
    ("<main><article><header><h1>T</h1></header><p>x</p><footer>f</footer></article></main>", "T\nx"),
    ("<article>x<section id='comments'><article>me too, a much longer text than the article</article></section></article>", "x"),
    ("<article><p>x</p></article><div class=comments><article>longer than the article itself</article></div>", "x"),
    ("<nav><ul><li>menu<article><p>unclosed nav</p></article>", "unclosed nav"),
    ("<script>var t='</p><article>no</article>'</script><p>x<style>p{}</style>y</p><!-- <p>c</p> -->", "xy"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><p title='a > b'>x</p><img alt='p>'>y", "x\ny"),
    ("<p>open <!-- never closed", "open"),
    ("<article><p>x</p><script>never closed", "x"),
    ("<article></article><p>beside</p>", ""),
    ("<title>t</title><textarea>ta</textarea><p>x</p>", "x"),
    ("</p></div><p>x</b></p>", "x"),
])
def test_text_of_a_page(source, expected):
    assert text(source) == expected


def test_deep_and_long_pages_take_linear_time():
    assert text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert text("<b>" * 50_000 + "x") == "x"
    assert text("<p>" + "word " * 400_000 + "</p>") == ("word " * 400_000).strip()
    assert text('<p a="' * 20_000 + ">x") is not None


def site(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_what_a_site_repeats_goes_and_shared_passages_stay(spark):
    notice = "<section><p>Read our rules before you post.</p></section>"
    menu = "<div class='q7'>" + "".join(f"<a href='/{k}'>Part {k}</a> " for k in range(4)) + "</div>"
    pages, expected = [], {}
    for k in range(12):
        shared = "<p>This passage stands in every article of the site.</p>"
        own = f"<p>Own text of article number {k}, which is rather longer than what stands around it, {'x' * k}.</p>"
        pages.append((k, "http://a.example.com/" + str(k), f"<body>{menu}<div class='story'>{own}{shared}</div>{notice}</body>"))
        expected[k] = re.sub("<[^>]*>", "\n", own + shared).replace("\n\n", "\n").strip()
    # nine addresses of one article on a site of twelve pages: no template
    copy = "<body><div class='s'><div><p>The same article under many addresses of the site.</p></div><p>Its end.</p></div></body>"
    for k in range(100, 109):
        pages.append((k, "http://b.example.com/" + str(k), copy))
        expected[k] = "The same article under many addresses of the site.\nIts end."
    for k in range(200, 203):
        pages.append((k, f"http://b.example.com/{k}", f"<body><div class='s'><p>Other {k} text, quite long too.</p></div></body>"))
        expected[k] = f"Other {k} text, quite long too."
    # a site too small to tell
    pages.append((300, "http://c.example.com/", f"<body>{notice}<p>A text that is longer than the notice around it.</p></body>"))
    expected[300] = "Read our rules before you post.\nA text that is longer than the notice around it."
    got = {r.page_id: r for r in main_texts(site(spark, pages)).collect()}
    assert {k: r.text for k, r in got.items()} == expected
    assert all(got[k].n_template == 2 for k in range(12)) and got[300].n_template == 0


def test_templates_are_the_hashes_counted_by_hand(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    beside, of = collections.defaultdict(set), collections.defaultdict(set)
    for r in pages.collect():
        host = re.match(r".*?://([^/?#]*)", r.url)[1].lower()
        for key, block in Page(r.html).counted():
            (of[host] if key == html_extract.ALL_PAGES else beside[host, key]).add(block)
    wanted = {(h, k) for (h, k), b in beside.items() if len(b) >= 2 and len(b) > 0.3 * len(of[h])}
    got = html_extract.templates(pages, least_pages=2).collect()
    assert {(r.host, k) for r in got for k in r.template} == wanted and wanted


def test_query_extracts_the_articles(spark, sf):
    got = {r.page_id: r for r in op11_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split())
                  for b in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a.example.com/", "<p>x</p>"), (2, "no host", "<p>y</p>"), (2, "no host", "<p>y</p>"),
            (3, "http://a.example.com/", ""), (4, None, "<article>" + "long " * 100_000 + "</article>")]
    pages = site(spark, rows).selectExpr("*", "'k' AS host", "1 AS template", "'t' AS text", "2 AS key")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_texts(pages).collect()), key=repr)
    long = ("long " * 100_000).strip()
    assert got == sorted([(1, None, "", 0), (None, "http://a.example.com/", "x", 1), (2, "no host", "y", 1), (2, "no host", "y", 1),
                          (3, "http://a.example.com/", "", 0), (4, None, long, len(long))], key=repr)
    assert main_texts(pages.limit(0)).collect() == []
