"""Links, pages and files of a crawl, over stored pages instead of a browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom import constants as C
from newsloom.functions import html as H, text as X, urls
from newsloom.functions.page_tree import page_fields
from newsloom.operators.ranking import first_n

ALL_ROWS = 2**31 - 1


def page_links(pages: DataFrame, inside: str | None = "h3", origin: str = "") -> DataFrame:
    """``(page_id, pos, href, url, text)`` of every link on every page."""
    links = pages.select("page_id", F.inline(H.anchors(H.without_noise(F.col("html")), inside)))
    return links.withColumn("url", urls.absolute_url(F.col("href"), origin))


def article_links(links: DataFrame, domain: str | list[str]) -> DataFrame:
    """Usable article links of each page, first occurrence of a URL only.

    Adds the cleaned title, the exclusive flag and the priority (0 exclusive).
    """
    text = F.col("text")
    usable = (
        (F.col("href") != "") & (F.length(text) >= C.MIN_LINK_TEXT_CHARS)
        & urls.is_article_url(F.col("url"), domain)
    )
    rows = links.filter(usable).withColumn("clean_url", urls.normalize_url(F.col("url")))
    rows = first_n(rows, ["page_id", "clean_url"], [F.col("pos").asc()], 1)
    return rows.select(
        "page_id", "pos", "url", "clean_url",
        urls.strip_exclusive_prefix(text).alias("title"),
        urls.has_exclusive_prefix(text).alias("is_exclusive"),
        urls.link_priority(text).alias("priority"),
    )


def listing_category(url: Column, origin: str) -> Column:
    """The seed category whose list page has this URL; of other pages what the URL says."""
    clean = urls.normalize_url(url)
    seeds = F.create_map(*[F.lit(v) for name, path in C.SEED_PATHS.items() for v in ((origin + path).rstrip("/"), name)])
    return F.coalesce(F.try_element_at(seeds, clean), urls.infer_category(url))


def link_quota(links: DataFrame, category: str = "category", home_cap: int | None = None, cap: int | None = None) -> DataFrame:
    """Links to fetch per category: exclusives first, then page order, up to the caps.

    The usual caps are ``HOME_LINK_CAP`` and ``CATEGORY_LINK_CAP``; without any
    every link is numbered.
    """
    order = [F.col("priority").asc(), F.col("pos").asc()]
    bounded = home_cap is not None and cap is not None
    ranked = first_n(links, [category], order, max(home_cap, cap) if bounded else ALL_ROWS, "turn")
    limit = F.when(F.col(category) == "home", F.lit(home_cap)).otherwise(F.lit(cap))
    return ranked.filter(F.col("turn") <= F.coalesce(limit, F.lit(ALL_ROWS)))


def extract_articles(pages: DataFrame) -> DataFrame:
    """Article fields of each page; content shorter than the minimum is dropped."""
    rows = pages.select("page_id", "url", page_fields(F.col("html")).alias("_page"))
    rows = rows.filter(F.length("_page.content") >= C.MIN_CONTENT_CHARS).select(
        "page_id",
        urls.normalize_url(F.col("url")).alias("url"),
        F.col("_page.headline").alias("title"),
        *[F.nullif(F.col(f"_page.{name}"), F.lit("")).alias(name) for name in ("subtitle", "author", "published_at")],
        "_page.content",
        "_page.is_exclusive",
    )
    return rows.withColumn("category", urls.infer_category(F.col("url")))


def merge_listing(scraped: DataFrame, links: DataFrame) -> DataFrame:
    """Scraped articles with what the listing said: title fallback, exclusive flag."""
    # a URL may be listed on several pages: the first title, exclusive if any says so
    listed = links.groupBy(F.col("clean_url").alias("url")).agg(
        F.min("title").alias("_title"), F.bool_or("is_exclusive").alias("_flag")
    )
    rows = scraped.join(listed, "url", "left")
    return rows.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("_title"))).withColumn(
        "is_exclusive", F.col("is_exclusive") | F.coalesce(F.col("_flag"), F.lit(False))
    ).drop("_title", "_flag")


def article_files(articles: DataFrame, day: str, stored: DataFrame | None = None) -> DataFrame:
    """Target path of each article file.

    Within (category, day, slug) the first file keeps the plain name and the
    later ones get ``_1``, ``_2`` and so on, in order of ``position``.  With the
    paths ``stored`` already, numbers go on after the largest one there.
    """
    folder = F.coalesce(F.col("category"), F.lit(C.DEFAULT_CATEGORY))
    named = articles.withColumn("_stem", F.concat(folder, F.lit(f"/{day}/"), urls.slug(F.col("url"))))
    turn = F.row_number().over(Window.partitionBy("_stem").orderBy("position"))
    named = named.withColumn("_turn", turn)
    if stored is not None:
        named = named.join(_taken(stored), "_stem", "left").withColumn("_turn", F.col("_turn") + F.coalesce("_used", F.lit(0))).drop("_used")
    suffix = F.when(F.col("_turn") == 1, F.lit("")).otherwise(F.concat(F.lit("_"), (F.col("_turn") - 1).cast("string")))
    return named.withColumn("path", F.concat("_stem", suffix, F.lit(".json"))).drop("_stem", "_turn")


def _taken(stored: DataFrame) -> DataFrame:
    """``_stem, _used``: for each name without number, how many of its numbers are used up.

    ``a_2.json`` uses up two numbers of ``a`` and, being a name of its own, one of ``a_2``.
    """
    stem = F.regexp_replace("path", r"\.json$", "")
    number = F.regexp_extract(stem, r"_(\d{1,9})$", 1).try_cast("long")
    names = F.array(F.struct(stem.alias("_stem"), F.lit(1).cast("long").alias("_used")),
                    F.struct(F.regexp_replace(stem, r"_\d{1,9}$", "").alias("_stem"), (number + 1).alias("_used")))
    return stored.select(F.inline(names)).filter("_used IS NOT NULL").groupBy("_stem").agg(F.max("_used").alias("_used"))


def crawl_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Articles per key with a grand total row (null key)."""
    return rows.rollup(*keys).agg(F.count("*").alias("articles"))


def archive_pages(days: DataFrame, origin: str) -> DataFrame:
    """URL of the archive page of each ``day``."""
    path = F.date_format("day", C.ARCHIVE_PATH_FORMAT)
    return days.select("day", F.concat(F.lit(origin + C.ARCHIVE_PATH_PREFIX), path).alias("url"))


def seed_pages(spark: SparkSession, origin: str) -> DataFrame:
    """The list pages to crawl, one per seed category."""
    return spark.createDataFrame(
        [(category, origin + path) for category, path in C.SEED_PATHS.items()], "category string, url string"
    )


def missing_days(days: DataFrame, today: str, max_days: int = C.BACKFILL_DAYS) -> DataFrame:
    """Days without data in the look-back window, newest first.

    The window starts at the first day with data or ``max_days`` ago, whichever
    is later; without any data nothing is missing.
    """
    end = F.lit(today).cast("date")
    present = days.select("day").filter(F.col("day").isNotNull()).distinct()
    start = F.when(F.min("day").isNotNull(), F.greatest(F.min("day"), F.date_sub(end, max_days)))
    bounds = present.agg(start.alias("start"))
    calendar = bounds.filter(F.col("start").isNotNull()).select(
        F.explode(F.sequence("start", end, F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    return calendar.join(present, "day", "left_anti").orderBy(F.col("day").desc())


def tag_profile(pages: DataFrame, tags: list[str] = H.PROFILE_TAGS) -> DataFrame:
    """Tag counts per page, only tags that occur."""
    names = pages.select("page_id", F.explode(H.tag_names(F.col("html"))).alias("tag")).filter(F.col("tag").isin(tags))
    return names.groupBy("page_id", "tag").agg(F.count("*").cast("int").alias("n"))


def attribute_profile(pages: DataFrame, attribute: str) -> DataFrame:
    """How often each value of an attribute occurs on each page."""
    values = pages.select("page_id", F.explode(H.attribute_values(F.col("html"), attribute)).alias("value"))
    return values.groupBy("page_id", "value").agg(F.count("*").cast("int").alias("n"))


def page_profile(pages: DataFrame) -> DataFrame:
    """Everything a page dump lists: title, tag, test-id and type counts."""
    html = F.col("html")
    return pages.select(
        "page_id", "url", H.title_tag(H.without_noise(html)).alias("title"),
        H.tag_counts(html, H.PROFILE_TAGS).alias("tags"),
        H.attribute_counts(html, "data-testid").alias("data_testid"),
        H.attribute_counts(html, "data-type").alias("data_type"),
    )


def challenge_pages(pages: DataFrame, site_name: str) -> DataFrame:
    """Pages titled with the bare site name, as verification pages are."""
    return pages.filter(F.lower(X.strip(H.title_tag(F.col("html")))) == site_name.lower())
