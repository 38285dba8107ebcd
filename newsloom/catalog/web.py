"""Queries over crawled pages and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.catalog import query, sql as Q
from newsloom.functions import html as H, text as T, urls
from newsloom.functions.page_tree import page_fields
from newsloom.operators import crawl, ledger
from newsloom.session import scratch_path
from newsloom.sources import fixtures as X
from newsloom.sources.article_writer import local_root, stored_paths, write_article_files
from newsloom.sources.articles import read_article_files

ORIGIN = "https://example.com"
CRAWL_DAY = "2024-01-31"


def _pages(spark, sf):
    return X.table(spark, sf, "pages")


@query("url_normalize", f"SELECT page_id, {Q.normalize_url('url')} AS clean_url FROM pages")
def url_normalize(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("clean_url"))


@query("url_article_id", f"""
SELECT page_id, md5({Q.normalize_url('url')}) AS article_id, substring(md5({Q.normalize_url('url')}), 1, 12) AS short_id,
       md5({Q.normalize_url('url')}) || '_0' AS first_chunk_id
FROM pages""")
def url_article_id(spark, sf):
    return X.table(spark, sf, "pages").select(
        "page_id", urls.article_id(F.col("url")).alias("article_id"), urls.short_id(F.col("url")).alias("short_id"),
        urls.chunk_id(urls.article_id(F.col("url")), F.lit(0)).alias("first_chunk_id"),
    )


@query("url_slug", f"SELECT page_id, {Q.slug('url')} || '.json' AS file_name FROM pages")
def url_slug(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", urls.file_name(F.col("url")).alias("file_name"))


# the fixture sites have language folders, so categories are inferred from link
# targets of the shape /<type>/<priority>/<key> built from other columns
@query("url_category", f"""
WITH links AS (SELECT p_partkey, 'https://example.com/' || replace(lower(p_type), ' ', '/') || '/' || p_partkey AS url FROM part
  UNION ALL SELECT 1000000 + o_orderkey, 'https://example.com' || CASE o_orderstatus WHEN 'O' THEN '/World/China' WHEN 'F' THEN '/opinion/free-expression' ELSE '/markets' END
    || CASE o_orderpriority WHEN '1-URGENT' THEN '/tech/' WHEN '2-HIGH' THEN '/US-News/' ELSE '/x/' END || o_orderkey FROM orders)
SELECT p_partkey AS link_id, {Q.category('url')} AS category FROM links""")
def url_category(spark, sf):
    part = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("link_id"),
        F.concat(F.lit("https://example.com/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey")).alias("url"),
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = X.table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1000000).alias("link_id"),
        F.concat(
            F.lit("https://example.com"),
            F.when(status == "O", "/World/China").when(status == "F", "/opinion/free-expression").otherwise("/markets"),
            F.when(priority == "1-URGENT", "/tech/").when(priority == "2-HIGH", "/US-News/").otherwise("/x/"),
            F.col("o_orderkey"),
        ).alias("url"),
    )
    return part.unionByName(orders).select("link_id", urls.infer_category(F.col("url")).alias("category"))


@query("article_url_filter", f"SELECT page_id, {Q.is_article_url('url', ['example.com', 'example.org'])} AS is_article FROM pages")
def article_url_filter(spark, sf):
    return X.table(spark, sf, "pages").select(
        "page_id", urls.is_article_url(F.col("url"), ["example.com", "example.org"]).alias("is_article")
    )


@query("url_clean_stats", f"""
SELECT count(*) AS total, count(*) FILTER (url <> {Q.normalize_url('url')}) AS needs_update,
       count(*) FILTER (url <> {Q.normalize_url('url')}) AS updated FROM pages""")
def url_clean_stats(spark, sf):
    return ledger.url_change_stats(X.table(spark, sf, "pages"), F.lit(True))


@query("url_clean_changes", f"""
SELECT page_id, url AS original, {Q.normalize_url('url')} AS cleaned FROM pages WHERE url <> {Q.normalize_url('url')}""")
def url_clean_changes(spark, sf):
    return ledger.url_changes(X.table(spark, sf, "pages"), "page_id")


@query("crawled_url_ledger", f"SELECT DISTINCT {Q.normalize_url('url')} AS url FROM pages")
def crawled_url_ledger(spark, sf):
    return ledger.url_ledger(X.table(spark, sf, "pages"))


_LINKS = f"""
found AS (
  SELECT page_id, (i - 1)::INT AS pos, a FROM (
    SELECT page_id, unnest(range(1, len(m) + 1)) AS i, m[i] AS a FROM (
      SELECT page_id, regexp_extract_all({Q.without_noise('html')}, '(?is)<a\\b[^>]*\\bhref=["''][^"'']*["''][^>]*>.*?</a\\s*>') AS m FROM pages))
),
links AS (
  SELECT page_id, pos, href, CASE WHEN starts_with(href, '/') THEN 'https://example.com' || href ELSE href END AS url, "text" FROM (
    SELECT page_id, pos, regexp_extract(a, '(?is)\\bhref=["'']([^"'']*)["'']', 1) AS href, {Q.inner_text('a')} AS "text" FROM found)
)"""


@query("page_links", f"WITH {_LINKS} SELECT page_id, pos, href, url, \"text\" FROM links")
def page_links(spark, sf):
    return crawl.page_links(_pages(spark, sf), None, ORIGIN)


# anchors wrap one word on these pages: their targets get an article path so
# that the usable-link rules have something to keep
_ARTICLE_LINKS = _LINKS + f""",
long_links AS (
  SELECT page_id, pos, href, url || '/story' AS url, CASE WHEN pos = 0 THEN 'EXCLUSIVE ' WHEN pos = 1 THEN 'excl: ' ELSE '' END || "text" || ' in depth' AS "text" FROM links
),
usable AS (
  SELECT *, {Q.normalize_url('url')} AS clean_url,
         row_number() OVER (PARTITION BY page_id, {Q.normalize_url('url')} ORDER BY pos) AS rn
  FROM long_links WHERE href <> '' AND length("text") >= 10 AND {Q.is_article_url('url', X.SITE_DOMAINS)}
),
article_links AS (
  SELECT page_id, pos, url, clean_url,
         {Q.strip('regexp_replace("text", ' + "'(?i)^(?:EXCLUSIVE\\s*\\n?\\s*|EXCL:\\s*)', '')")} AS title,
         regexp_matches("text", '(?i)^(EXCLUSIVE|EXCL:)') AS is_exclusive,
         CASE WHEN regexp_matches("text", '(?i)^(EXCLUSIVE|EXCL:)') THEN 0 ELSE 1 END AS priority
  FROM usable WHERE rn = 1
)"""


def _article_links(spark, sf):
    links = crawl.page_links(_pages(spark, sf), None, ORIGIN)
    prefix = F.when(F.col("pos") == 0, "EXCLUSIVE ").when(F.col("pos") == 1, "excl: ").otherwise("")
    links = links.withColumn("url", F.concat("url", F.lit("/story"))).withColumn(
        "text", F.concat(prefix, F.col("text"), F.lit(" in depth"))
    )
    return crawl.article_links(links, X.SITE_DOMAINS)


@query("article_links", f"WITH {_ARTICLE_LINKS} SELECT * FROM article_links")
def article_links(spark, sf):
    return _article_links(spark, sf)


@query("page_exclusive_counts", f"""
WITH {_ARTICLE_LINKS} SELECT page_id, count(*) AS links, count(*) FILTER (is_exclusive) AS exclusive FROM article_links GROUP BY page_id""")
def page_exclusive_counts(spark, sf):
    return _article_links(spark, sf).groupBy("page_id").agg(
        F.count("*").alias("links"), F.count_if("is_exclusive").alias("exclusive")
    )


@query("new_links", f"""
WITH {_ARTICLE_LINKS}, known AS (
  SELECT {Q.normalize_url('url')} AS clean_url FROM pages
  UNION SELECT 'https://example.com/the/story' UNION SELECT 'https://example.com/and/story')
SELECT page_id, pos, clean_url FROM article_links WHERE clean_url NOT IN (SELECT clean_url FROM known)""")
def new_links(spark, sf):
    crawled = ledger.url_ledger(X.table(spark, sf, "pages"))
    skipped = spark.createDataFrame(
        [("https://example.com/the/story",), ("https://example.com/and/story",)], "url string"
    )
    links = _article_links(spark, sf).drop("clean_url")
    return ledger.new_links(links, crawled, skipped).select("page_id", "pos", "clean_url")


# documents as list-page links: source = category, labels decide exclusivity
_QUOTA = """
links AS (
  SELECT doc_id AS pos, CASE WHEN source = 'src0' THEN 'home' ELSE source END AS category,
         CASE WHEN coalesce(l.quality, 0) = 1 THEN 0 ELSE 1 END AS priority
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


@query("listing_links", """
SELECT doc_id AS page_id, 'https://example.com/' || source || '/' || doc_id AS url, 'story ' || doc_id AS text FROM documents
UNION ALL SELECT doc_id, 'https://example.com/last/' || doc_id, 'last of ' || lang FROM documents""")
def listing_links(spark, sf):
    """Links in headings only, on list pages made of the documents."""
    doc_id = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit("<nav><a href='/menu'>menu</a></nav><h3 class=x><a href=\"/"), F.col("source"), F.lit("/"), doc_id, F.lit("\"><b>story "), doc_id,
        F.lit("</b></a></h3><p><a href='/in-text'>in the text</a></p><h3><a href='/last/"), doc_id, F.lit("'>last of "), F.col("lang"),
        F.lit("</a></h3><h2><a href='/other'>other</a></h2>"))
    pages = X.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return crawl.page_links(pages, origin=ORIGIN).select("page_id", "url", "text")


@query("link_quota", f"""
WITH {_QUOTA}, ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority, pos) AS turn FROM links)
SELECT pos, category, priority, turn::INT AS turn FROM ranked WHERE turn <= CASE WHEN category = 'home' THEN 40 ELSE 30 END""")
def link_quota(spark, sf):
    labels = X.table(spark, sf, "labels").select("doc_id", "quality")
    links = X.table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("pos"),
        F.when(F.col("source") == "src0", "home").otherwise(F.col("source")).alias("category"),
        F.when(F.coalesce("quality", F.lit(0)) == 1, 0).otherwise(1).alias("priority"),
    )
    return crawl.link_quota(links, home_cap=40, cap=30)


@query("html_fields", f"""
WITH p AS (SELECT page_id, {Q.without_noise('html')} AS html FROM pages)
SELECT page_id, {Q.inner_text(Q.element('html', 'title'))} AS page_title, {Q.inner_text(Q.element('html', 'h1'))} AS headline FROM p""")
def html_fields(spark, sf):
    pages = T.computed_once(_pages(spark, sf), ["page_id"], html=H.without_noise(F.col("html")))
    return pages.select("page_id", H.title_tag(F.col("html")).alias("page_title"), H.headline(F.col("html")).alias("headline"))


@query("html_body", f"""
WITH p AS (SELECT page_id, {Q.without_noise('html')} AS html FROM pages),
t AS (SELECT page_id, {Q.kept_paragraphs('html')} AS kept FROM p)
SELECT page_id, len(kept)::INT AS paragraphs, array_to_string(kept, chr(10) || chr(10)) AS body FROM t""")
def html_body(spark, sf):
    pages = T.computed_once(_pages(spark, sf), ["page_id"], html=H.without_noise(F.col("html")))
    kept = H.keep_fallback_paragraphs(H.article_paragraphs(F.col("html")))
    return pages.select("page_id", F.size(kept).alias("paragraphs"), H.body_text(F.col("html")).alias("body"))


_SCRAPED = f"""
p AS (SELECT page_id, url, {Q.without_noise('html')} AS html FROM pages),
scraped AS (
  SELECT page_id, {Q.normalize_url('url')} AS url, {Q.inner_text(Q.element('html', 'h1'))} AS title,
         array_to_string({Q.kept_paragraphs('html')}, chr(10) || chr(10)) AS content,
         regexp_matches(html, '(?i)aria-label=["''][^"'']*exclusive') AS is_exclusive
  FROM p
)"""


@query("scraped_articles", f"""
WITH {_SCRAPED} SELECT page_id, url, title, content, is_exclusive, {Q.category('url')} AS category
FROM scraped WHERE length(content) >= 100""")
def scraped_articles(spark, sf):
    return crawl.extract_articles(_pages(spark, sf)).select(
        "page_id", "url", "title", "content", "is_exclusive", "category"
    )


@query("listing_merge", f"""
WITH {_SCRAPED}, listed AS (
  SELECT {Q.normalize_url('p.url')} AS url, min('Page ' || page_id || ' ' || o) AS title, bool_or(l.quality = 1 AND o = 1) AS flag
  FROM pages p JOIN labels l ON l.doc_id = p.page_id, (VALUES (1), (2)) t(o) GROUP BY 1)
SELECT page_id, s.url, coalesce(nullif(s.title, ''), l.title) AS title, is_exclusive OR coalesce(l.flag, false) AS is_exclusive
FROM scraped s LEFT JOIN listed l USING (url) WHERE length(content) >= 100""")
def listing_merge(spark, sf):
    pages = X.table(spark, sf, "pages")
    labels = X.table(spark, sf, "labels").withColumnRenamed("doc_id", "page_id")
    # every URL is listed twice, once without its flag
    links = pages.select("page_id", "url", F.explode(F.array(F.lit(1), F.lit(2))).alias("o")).join(labels, "page_id").select(
        urls.normalize_url(F.col("url")).alias("clean_url"),
        F.concat(F.lit("Page "), F.col("page_id"), F.lit(" "), F.col("o")).alias("title"),
        ((F.col("quality") == 1) & (F.col("o") == 1)).alias("is_exclusive"),
    )
    merged = crawl.merge_listing(crawl.extract_articles(_pages(spark, sf)), links)
    return merged.select("page_id", "url", "title", "is_exclusive")


@query("article_files", f"""
WITH n AS (
  SELECT page_id, {Q.category('url')} AS folder, {Q.slug('url')} AS slug FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, slug ORDER BY page_id) AS turn FROM n)
SELECT page_id, folder || '/{CRAWL_DAY}/' || slug || CASE WHEN turn = 1 THEN '' ELSE '_' || (turn - 1) END || '.json' AS path FROM k""")
def article_files(spark, sf):
    pages = X.table(spark, sf, "pages").select(
        "page_id", "url", urls.infer_category(F.col("url")).alias("category"), F.col("page_id").alias("position")
    )
    return crawl.article_files(pages, CRAWL_DAY).select("page_id", "path")


@query("article_files_written", f"""
WITH n AS (
  SELECT page_id, url, {Q.category('url')} AS folder, {Q.slug('url')} AS slug, page_id > (SELECT median(page_id) FROM pages) AS later FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, slug ORDER BY later, page_id) AS turn FROM n)
SELECT folder || '/{CRAWL_DAY}/' || slug || CASE WHEN turn = 1 THEN '' ELSE '_' || (turn - 1) END || '.json' AS path,
  url, 'page ' || page_id AS title FROM k""")
def article_files_written(spark, sf):
    """Files of all pages written in two runs, the earlier half of the pages first, and read again."""
    root = f"{scratch_path(spark, 'article-files')}/articles"
    pages = X.table(spark, sf, "pages").select(
        "page_id", "url", urls.infer_category(F.col("url")).alias("category"), F.col("page_id").alias("position"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))
    middle = pages.agg(F.median("page_id")).scalar()
    for half in (F.col("page_id") <= middle, F.col("page_id") > middle):
        named = crawl.article_files(pages.filter(half), CRAWL_DAY, stored_paths(spark, root))
        write_article_files(named.select("path", "url", "title", "category"), root)
    files = read_article_files(spark, root)
    return files.select(F.substring_index("path", f"{local_root(root)}/", -1).alias("path"), "url", "title")


@query("crawl_totals", """
SELECT source, lang, count(*) AS articles FROM documents GROUP BY ROLLUP (source, lang)""")
def crawl_totals(spark, sf):
    return crawl.crawl_totals(X.table(spark, sf, "documents"), "source", "lang")


@query("tag_profile", """
WITH tags AS (SELECT unnest(['h1','h2','h3','h4','h5','p','a','div','span','article','section','nav','header','footer','ul','li','figure','img','time','button']) AS tag),
names AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
SELECT page_id, tag, count(*)::INT AS n FROM names SEMI JOIN tags USING (tag) GROUP BY page_id, tag""")
def tag_profile(spark, sf):
    return crawl.tag_profile(_pages(spark, sf))


@query("tag_totals", """
WITH names AS (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
SELECT tag, count(*)::BIGINT AS n FROM names WHERE tag IN ('h1','h2','h3','h4','p','a','div','article','section') GROUP BY tag""")
def tag_totals(spark, sf):
    return crawl.tag_profile(_pages(spark, sf), H.INFO_TAGS).groupBy("tag").agg(F.sum("n").alias("n"))


@query("class_counts", """
WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)\\sclass=["'']([^"'']*)["'']', 1)) AS value FROM pages)
SELECT page_id, value, count(*)::INT AS n FROM v GROUP BY page_id, value""")
def class_counts(spark, sf):
    return crawl.attribute_profile(_pages(spark, sf), "class")


@query("element_samples", f"""
WITH m AS (SELECT page_id, (regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1))[1:10] AS found FROM pages),
e AS (SELECT page_id, unnest(range(1, len(found) + 1)) AS i, found[i] AS x FROM m)
SELECT page_id, (i - 1)::INT AS pos, replace(substring({Q.inner_text('x')}, 1, 80), chr(10), ' ') AS sample FROM e""")
def element_samples(spark, sf):
    return _pages(spark, sf).select("page_id", F.posexplode(H.element_samples(F.col("html"), "li")).alias("pos", "sample"))


@query("attribute_samples", """
WITH m AS (SELECT page_id, (regexp_extract_all(html, '(?is)<a(\\s[^>]*)>', 1))[1:5] AS found FROM pages),
e AS (SELECT page_id, unnest(range(1, len(found) + 1)) AS i, found[i] AS x FROM m),
v AS (SELECT page_id, i, regexp_extract(x, 'href=["'']([^"'']*)["'']', 1) AS href FROM e)
SELECT page_id, (i - 1)::INT AS pos, 'href=' || CASE WHEN length(href) > 60 THEN substring(href, 1, 60) || '...' ELSE href END AS sample FROM v""")
def attribute_samples(spark, sf):
    return _pages(spark, sf).select("page_id", F.posexplode(H.attribute_samples(F.col("html"), "a")).alias("pos", "sample"))


@query("archive_pages", """
SELECT DISTINCT ts::DATE AS "day", 'https://example.com/news/archive/' || strftime(ts, '%Y/%m/%d') AS url FROM events""")
def archive_pages(spark, sf):
    days = X.table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return crawl.archive_pages(days, ORIGIN)


@query("missing_days", """
WITH present AS (SELECT DISTINCT ts::DATE AS "day" FROM events WHERE event_type = 'error' AND value > 180)
SELECT d::DATE AS "day" FROM (SELECT unnest(generate_series(
  (SELECT greatest(min("day"), DATE '2024-01-31' - 20) FROM present)::TIMESTAMP, TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d)
WHERE d::DATE NOT IN (SELECT "day" FROM present)""")
def missing_days(spark, sf):
    kept = X.table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("value") > 180))
    return crawl.missing_days(kept.select(F.col("ts").cast("date").alias("day")), CRAWL_DAY, 20)


@query("seed_coverage", """
WITH seeds AS (SELECT unnest(['home','world','china','tech','finance','business','politics','economy','opinion','arts','lifestyle','real-estate','personal-finance','health','style','sports','us-news']) AS category),
seen AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'tech' WHEN '2-HIGH' THEN 'us' ELSE lower(substring(o_orderpriority, 3)) END AS category, count(*) AS articles FROM orders GROUP BY 1)
SELECT s.category, coalesce(articles, 0) AS articles FROM seeds s LEFT JOIN seen USING (category)""")
def seed_coverage(spark, sf):
    priority = F.col("o_orderpriority")
    seen = X.table(spark, sf, "orders").groupBy(
        F.when(priority == "1-URGENT", "tech").when(priority == "2-HIGH", "us")
        .otherwise(F.lower(F.substring(priority, 3, 100))).alias("category")
    ).agg(F.count("*").alias("articles"))
    seeds = crawl.seed_pages(spark, ORIGIN).select("category")
    return seeds.join(seen, "category", "left").select("category", F.coalesce("articles", F.lit(0)).alias("articles"))


@query("scrape_outcome", f"""
WITH {_SCRAPED} SELECT CASE WHEN length(content) >= 100 THEN 'saved' ELSE 'skipped' END AS outcome, count(*) AS pages FROM scraped GROUP BY 1""")
def scrape_outcome(spark, sf):
    body = H.body_text(H.without_noise(F.col("html")))
    return _pages(spark, sf).select(
        F.when(F.length(body) >= C.MIN_CONTENT_CHARS, "saved").otherwise("skipped").alias("outcome")
    ).groupBy("outcome").agg(F.count("*").alias("pages"))


# --- marked-up pages made of the documents: what went in has to come out -----------------

_MARKED_LAYOUTS = [
    ("<div data-testid=\"paragraph\"><div><b>", "</b></div> and <div>so on.</div></div>"),
    ("<p data-type=\"paragraph\"><span><span>", "</span> and <span>so on.</span></span></p>"),
    ("<div><p><em>", "</em> and <i>so&#32;on.</i></p><div>aside</div></div>"),
]
_CRUMB = "<nav class=\"top breadcrumb\"><div><div>Home</div> &gt; <div>{}</div></div></nav>"
_MARKS = [
    "", "<span aria-label=\"An Exclusive story\">x</span>",
    "<div data-testid=\"content-tag\"><div>Today</div><div>EXCLUSIVE</div></div>",
    _CRUMB.format("Exclusive"), _CRUMB.format("World") + _CRUMB.format("Exclusive"),
]


def _escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _marked_pages(spark, sf):
    """One page per document: a sentence a paragraph, layout and mark by its id."""
    docs = X.table(spark, sf, "documents").filter("doc_id IS NOT NULL")
    docs = T.computed_once(docs, ["doc_id", "lang", "source"], parts=T.sentences(F.coalesce(F.col("text"), F.lit(""))))
    open_tag, close_tag = (
        F.element_at(F.array(*[F.lit(layout[k]) for layout in _MARKED_LAYOUTS]), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
        for k in (0, 1))
    body = F.array_join(F.transform("parts", lambda x: F.concat(open_tag, _escaped(x), close_tag)), "\n")
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    number = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("<html><body>"), mark, F.lit("<h1>Site</h1><div data-testid=\"headline\"><div>Story <div>no. </div></div>"), number,
        F.lit("</div><div data-testid=\"dek-block\"><div>About</div> "), F.coalesce("source", F.lit("")),
        F.lit("</div><span data-testid=\"byline\"><span>By </span><span>"), F.coalesce("lang", F.lit("")),
        F.lit(" Desk</span></span><time>late</time><div data-testid=\"timestamp-text\"><div>day</div> "), number, F.lit("</div>"))
    return docs.select("doc_id", F.concat(head, F.lit("<article>"), body, F.lit("</article></body></html>")).alias("html"))


def _marked_fields(spark, sf):
    return _marked_pages(spark, sf).select("doc_id", page_fields(F.col("html")).alias("page"))


@query("html_layouts", f"""
WITH d AS (SELECT doc_id, {Q.sentences("coalesce(text, '')")} AS parts FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, list_transform(parts, lambda x: {Q.strip("(x || ' and so on.')")}) AS texts FROM d),
k AS (SELECT doc_id, list_filter(texts, lambda t: length(t) > 20 AND NOT contains(t, 'Advertisement')) AS good,
  list_filter(texts, lambda t: length(t) > 30 AND NOT contains(t, 'Advertisement') AND NOT contains(t, 'copyright')
    AND NOT contains(t, 'Subscriber Agreement') AND NOT starts_with(t, 'Write to ')) AS plain FROM t),
c AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND len(good) > 2 THEN (doc_id % 3 + 1)::INT ELSE 3 END AS layout, good, plain FROM k),
p AS (SELECT doc_id, layout, CASE WHEN layout < 3 THEN good WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE plain END AS kept FROM c)
SELECT doc_id, layout, len(kept)::INT AS paragraphs, array_to_string(kept, chr(10) || chr(10)) AS content FROM p""")
def html_layouts(spark, sf):
    return _marked_fields(spark, sf).select("doc_id", "page.layout", "page.paragraphs", "page.content")


@query("html_meta", f"""
SELECT doc_id, 'Story no. ' || doc_id AS headline, {Q.strip("('About ' || coalesce(source, ''))")} AS subtitle,
  {Q.strip("(coalesce(lang, '') || ' Desk')")} AS author, 'day ' || doc_id AS published_at FROM documents WHERE doc_id IS NOT NULL""")
def html_meta(spark, sf):
    return _marked_fields(spark, sf).select("doc_id", "page.headline", "page.subtitle", "page.author", "page.published_at")


@query("exclusive_marks", """
SELECT doc_id, doc_id % 5 IN (1, 2, 3) AS is_exclusive FROM documents WHERE doc_id IS NOT NULL""")
def exclusive_marks(spark, sf):
    return _marked_fields(spark, sf).select("doc_id", "page.is_exclusive")
