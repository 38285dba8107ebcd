"""Reports: query results, trends, comparison, research, corpus info, daily briefing.

Counts and shares are taken over everything a report covers; the lines it shows
come from results that a limit has made small, so collecting them is bounded.  Without a
text generator the reports use their plain, deterministic layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import constants as C
from newsloom.functions import dates, render, replies, text as X
from newsloom.operators import recency
from newsloom.operators.ranking import best_per_article, numbered
from newsloom.operators.vector import with_rows
from newsloom.plans import briefing
from newsloom.plans.engine import Engine, Intent, ROW_COLUMNS, analyze

def _newest() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("article_id").asc()]


def _lines(order: Sequence[str | Column], line: Column, separator: str = "\n") -> Column:
    """Aggregate: lines in the given order, joined."""
    packed = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return F.array_join(F.transform(packed, lambda r: r["line"]), separator)


def _message(engine: Engine, text: str) -> DataFrame:
    return engine.chunks.sparkSession.range(1).select(F.lit(text).alias("report"))


def _stamp(col: Column, missing: str) -> Column:
    return F.coalesce(dates.iso_text(col), F.lit(missing))


def _filled(col: Column, missing: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(missing))


# --- news query ---------------------------------------------------------------------

def news_query_report(engine: Engine, query: str, max_results: int = 5, intent: Intent | None = None) -> DataFrame:
    """Numbered result blocks, with a summary first when one was asked for."""
    intent = intent or analyze(query)
    rows = engine.news_query(query, max_results, intent)
    order = [F.col("score").desc_nulls_last(), *_newest()]
    shown = numbered(rows, order)
    blocks = shown.select(
        "no", "quality",
        F.concat(F.lit("--- Article "), F.col("no").cast("string"), F.lit(" ---\n"), render.result_text(
            lambda name: {
                "published_at": dates.iso_text(F.col("published_at")),
                "summary": render.summary(F.col("article_summary"), F.col("chunk_summary")),
            }.get(name, F.col(name))
        ), F.lit("\n")).alias("block"),
        "title",
    )
    body = blocks.agg(
        F.count("*").alias("n"), F.max("quality").alias("quality"),
        _lines(["no"], F.col("block")).alias("blocks"),
        _lines(["no"], F.concat(F.lit("- "), F.col("title"))).alias("titles"),
    )
    head = F.concat(
        F.lit("Found "), F.col("n").cast("string"), F.lit(" relevant articles (quality: "),
        F.col("quality").cast("string"), F.lit("/5):\n\n"),
    )
    overview = F.lit("")
    if intent.needs_summary:
        # --- fixed values: section titles ---
        overview = F.concat(F.lit("=== 新闻总结 ===\n"), F.col("titles"), F.lit("\n\n=== 详细文章 ===\n"))
    return body.select(
        F.when(F.col("n") == 0, F.lit(f"No news articles found for query: '{query}'"))
        .otherwise(F.concat(overview, head, F.col("blocks"))).alias("report")
    )


# --- trends ----------------------------------------------------------------------------

def trend_articles(engine: Engine, category: str | None = None, hours: int = 72) -> DataFrame:
    """Every article of the window, one row each."""
    hours = C.clamp("trend_hours", hours)
    return recency.recent_news(engine.chunks, engine.asof, hours, None, category)


def category_distribution(articles: DataFrame) -> DataFrame:
    """Articles per category, most first, ties to the newest article."""
    return (
        articles.filter(F.coalesce(F.col("category"), F.lit("")) != "")
        .groupBy("category").agg(F.count("*").alias("articles"), F.max("published_at").alias("newest"))
        .orderBy(F.col("articles").desc(), F.col("newest").desc(), F.col("category").asc())
    )


def title_topics(articles: DataFrame, top_n: int) -> DataFrame:
    """The newest titles, which stand for topics when no model names any."""
    titled = articles.filter(F.coalesce(F.col("title"), F.lit("")) != "").select("published_at", "article_id", "title")
    return numbered(titled.orderBy(*_newest()).limit(top_n), _newest()).select("no", "title")


def trend_report(engine: Engine, category: str | None = None, hours: int = 72, top_n: int = 5) -> DataFrame:
    hours, top_n = C.clamp("trend_hours", hours), C.clamp("trend_topics", top_n)
    articles = trend_articles(engine, category, hours)
    total = articles.agg(F.count("*")).scalar()
    shares = category_distribution(articles).agg(
        _lines([(-F.col("articles")).alias("a"), (-F.unix_micros(F.col("newest").cast("timestamp"))).alias("n"), "category"],
               F.concat(F.lit("  - "), F.col("category"), F.lit(": "), F.col("articles").cast("string"), F.lit(" 篇")))
    ).scalar()
    topics = title_topics(articles, top_n)
    listed = topics.agg(
        F.concat(
            F.lit("  (基于标题的前 "), F.count("*").cast("string"), F.lit(" 条新闻)\n"),
            _lines(["no"], F.concat(F.lit("  "), F.col("no").cast("string"), F.lit(". "), F.col("title"))),
        )
    ).scalar()
    nothing = f"No news articles found in the last {hours} hours" + (f" for category '{category}'" if category else "") + "."
    # --- fixed values: report layout ---
    report = F.concat(
        F.lit(f"=== 新闻趋势分析报告 ===\n时间范围: 最近 {hours} 小时\n文章总数: "), total.cast("string"),
        F.lit(" 篇\n\n--- 分类分布 ---\n"), _filled(shares, "  (无分类信息)"),
        F.lit(f"\n\n--- 热门话题 Top {top_n} ---\n"), listed, F.lit("\n"),
    )
    one = engine.chunks.sparkSession.range(1)
    return one.select(F.when(total == 0, F.lit(nothing)).otherwise(report).alias("report"))


# --- comparison ---------------------------------------------------------------------------

def compare_topics(engine: Engine, topics: Sequence[str], max_per_topic: int = 3) -> DataFrame:
    """Best articles of each topic, found in one pass over the corpus."""
    names = list(dict.fromkeys(t.strip() for t in topics if t.strip()))
    limit = C.clamp("compare_per_topic", max_per_topic)
    hits = engine.batch([(t, t) for t in names], 2 * limit, limit)
    rows = with_rows(hits, engine.chunks, ROW_COLUMNS)
    return rows.select(
        F.col("name").alias("topic"), "rank", "article_id", "score",
        _filled(F.col("title"), "N/A").alias("title"),
        render.summary(F.col("article_summary"), F.col("chunk_summary")).alias("summary"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("url", F.lit("")).alias("url"),
        "published_at",
        F.coalesce("category", F.lit("")).alias("category"),
    )


def compare_report(engine: Engine, topics: str, max_per_topic: int = 3) -> DataFrame:
    asked = [t.strip() for t in topics.split(",") if t.strip()]
    if len(asked) < 2:
        return _message(engine, "Error: Please provide at least 2 topics separated by commas.")
    if len(asked) > 4:
        return _message(engine, "Error: Maximum 4 topics allowed.")
    rows = compare_topics(engine, asked, max_per_topic)
    spark = engine.chunks.sparkSession
    order = spark.createDataFrame(list(enumerate(dict.fromkeys(asked))), "place int, topic string")
    no = F.col("rank").cast("string")
    summary = lambda indent: F.when(F.col("summary") != "", F.concat(F.lit(f"\n{indent}"), F.col("summary"))).otherwise(F.lit(""))
    per_topic = rows.groupBy("topic").agg(
        F.count("*").alias("n"),
        _lines(["rank"], F.concat(F.lit("- "), F.col("title"), summary("  "))).alias("brief"),
        _lines(["rank"], F.concat(
            F.lit("["), no, F.lit("] "), F.col("title"),
            F.lit("\n    Published: "), _stamp(F.col("published_at"), "N/A"),
            F.lit("\n    Category: "), _filled(F.col("category"), "N/A"),
            F.lit("\n    URL: "), _filled(F.col("url"), "N/A"),
            summary("    Summary: "), F.lit("\n"),
        )).alias("detail"),
    )
    merged = order.join(per_topic, "topic", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts = merged.agg(
        F.sum("n").alias("total"),
        _lines(["place"], F.concat(
            F.lit("### "), F.col("topic"), F.lit("\n"), F.coalesce("brief", F.lit("- No articles found")), F.lit("\n")
        )).alias("brief"),
        _lines(["place"], F.concat(
            F.lit("\n--- "), F.col("topic"), F.lit(" ("), F.col("n").cast("string"), F.lit(" articles) ---\n"),
            F.coalesce("detail", F.lit("No articles found.")),
        )).alias("detail"),
    )
    names = ", ".join(asked)
    # --- fixed values: report layout ---
    return parts.select(F.when(
        F.col("total") == 0, F.lit(f"No articles found for any of the topics: {names}")
    ).otherwise(F.concat(
        F.lit(f"=== 多主题对比分析报告 ===\n主题: {names}\n\n## 对比分析（LLM 生成失败，以下为原始数据摘要）\n\n"),
        F.col("brief"), F.lit("\n\n=== 原始文章数据 ===\n"), F.col("detail"),
    )).alias("report"))


# --- research ------------------------------------------------------------------------------

def research_angles(topic: str) -> list[tuple[str, str]]:
    """The default angles of a topic; a model reply goes through ``replies.parse_angles``."""
    return [(name, f"{topic} {suffix}".strip()) for name, suffix in replies.DEFAULT_ANGLES]


def research_articles(
    engine: Engine, topic: str, max_results: int = 10, angles: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Search from each angle, keep each article's best hit, best scores first."""
    limit = C.clamp("research_results", max_results)
    angles = list(angles or research_angles(topic))
    per_angle = max(2, limit // len(angles) + 1)
    hits = engine.batch(angles, 2 * per_angle, per_angle)
    merged = best_per_article(hits.drop("rank"), limit, rank="no")
    return with_rows(merged, engine.chunks, ROW_COLUMNS)


def research_report(
    engine: Engine, topic: str, max_results: int = 10, angles: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    rows = research_articles(engine, topic, max_results, angles)
    summary = render.summary(F.col("article_summary"), F.col("chunk_summary"))
    no = F.col("no").cast("string")
    title = F.concat(no, F.lit(". 「"), F.col("title"), F.lit("」"))
    parts = rows.agg(
        F.count("*").alias("n"),
        _lines(["no"], F.when(summary != "", F.concat(title, F.lit("："), summary)).otherwise(title)).alias("brief"),
        _lines(["no"], F.concat(
            title, F.lit(" ["), _filled(F.col("category"), "未分类"), F.lit("] ("),
            _stamp(F.col("published_at"), "未知日期"), F.lit(")\n   "), F.col("url"),
        )).alias("sources"),
    )
    n = F.col("n").cast("string")
    # --- fixed values: report layout ---
    return parts.select(F.when(
        F.col("n") == 0, F.lit(f"未能找到与「{topic}」相关的新闻文章，请尝试更换关键词。")
    ).otherwise(F.concat(
        F.lit(f"# 深度研究报告：{topic}\n*基于 "), n, F.lit(f" 篇相关文章的多角度分析*\n\n## 概述\n以下是关于「{topic}」的相关新闻汇总（共 "),
        n, F.lit(" 篇）。\n\n## 相关文章摘要\n"), F.col("brief"),
        F.lit("\n\n*注：由于分析服务暂时不可用，仅提供文章摘要。*\n\n---\n## 参考文章\n"), F.col("sources"),
    )).alias("report"))


# --- corpus information ------------------------------------------------------------------------

def database_info(
    engine: Engine, query_type: str = "stats", category: str | None = None, limit: int = 5, exact: bool = False
) -> DataFrame:
    """``stats``, ``latest`` or ``categories``; anything else means ``stats``.

    The article count is a sketch unless ``exact``.
    """
    limit = C.clamp("database_limit", limit)
    if query_type == "latest":
        return _latest_report(engine, category, limit)
    stats = recency.database_stats(engine.chunks, exact)
    line = lambda c: F.concat(F.lit("  "), c["category"], F.lit(": "), c["doc_count"].cast("string"), F.lit(" 条记录"))
    shares = F.array_join(F.transform("categories", line), "\n")
    articles = F.col("total_articles").cast("string")
    # --- fixed values: report layout ---
    if query_type == "categories":
        text = F.concat(F.lit("=== 分类分布 (共 "), articles, F.lit(" 篇文章) ===\n\n"), shares)
        return stats.select(F.when(F.size("categories") == 0, F.lit("没有找到分类信息。")).otherwise(text).alias("report"))
    text = F.concat(
        F.lit("=== 数据库统计 ===\n总文章数: "), articles,
        F.lit("\n总分块数: "), F.col("total_chunks").cast("string"),
        F.lit("\n最新文章日期: "), _stamp(F.col("latest_date"), "N/A"),
        F.lit("\n最早文章日期: "), _stamp(F.col("oldest_date"), "N/A"),
        F.when(F.size("categories") > 0, F.concat(F.lit("\n\n分类分布:\n"), shares)).otherwise(F.lit("")),
    )
    return stats.select(text.alias("report"))


def _latest_report(engine: Engine, category: str | None, limit: int) -> DataFrame:
    rows = numbered(recency.latest_articles(engine.chunks, limit, category), _newest())
    summary = F.when(
        F.coalesce(F.col("article_summary"), F.lit("")) != "",
        F.concat(F.lit("\n   摘要: "), F.substring("article_summary", 1, C.LATEST_SUMMARY_CHARS), F.lit("...")),
    ).otherwise(F.lit(""))
    parts = rows.agg(F.count("*").alias("n"), _lines(["no"], F.concat(
        F.col("no").cast("string"), F.lit(". 「"), F.col("title"), F.lit("」\n   分类: "),
        _filled(F.col("category"), "N/A"), F.lit(" | 发布: "), _stamp(F.col("published_at"), "N/A"),
        F.lit("\n   URL: "), F.col("url"), summary, F.lit("\n"),
    )).alias("list"))
    return parts.select(F.when(F.col("n") == 0, F.lit("数据库中没有找到文章。")).otherwise(
        F.concat(F.lit("=== 最新 "), F.col("n").cast("string"), F.lit(" 篇文章 ===\n\n"), F.col("list"))
    ).alias("report"))


# --- daily briefing ------------------------------------------------------------------------------

def daily_articles(engine: Engine, day: str) -> DataFrame:
    """Every article of a day, one row each."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(C.DEFAULT_CATEGORY))
    return recency.articles_by_date(engine.chunks, day).withColumn("category", category)


def _daily_title() -> Column:
    return F.concat(F.lit("- 「"), F.col("title"), F.lit("」"))


def _daily_note() -> Column:
    summary = render.summary(F.col("article_summary"), F.col("chunk_summary"))
    return F.when(summary != "", F.concat(F.lit("\n  摘要: "), summary)).when(
        F.coalesce(F.col("content"), F.lit("")) != "",
        F.concat(F.lit("\n  内容: "), F.substring("content", 1, C.DAILY_PREVIEW_CHARS)),
    ).otherwise(F.lit(""))


def daily_lines(engine: Engine, day: str) -> DataFrame:
    """``category, pos, article_id, plain, line``: the day's articles as rows, numbered by category, newest first.

    ``plain`` is the title line, ``line`` has the summary too.  However many
    articles a category has, they are numbered without meeting in one task.
    """
    title = _daily_title()
    rows = daily_articles(engine, day).select(
        "category", "published_at", "article_id", title.alias("plain"), F.concat(title, _daily_note()).alias("line"))
    return briefing.placed(rows, "category", _newest()).select("category", "pos", "article_id", "plain", "line")


def daily_digest(engine: Engine, day: str, block: int = briefing.BLOCK) -> DataFrame:
    """``category, n, line``: the newest and the oldest headline of each category, folded in blocks."""
    def ends(_: Column, text: Column, plain: Column) -> Column:
        parts = F.split(text, "\n| … ")
        return F.concat(F.element_at(parts, 1), F.lit(" … "), F.element_at(parts, -1))

    lines = daily_lines(engine, day).withColumn("line", F.col("plain"))
    return briefing.folded(lines, "category", ends, block, "\n")


def daily_groups(engine: Engine, day: str, listed: int | None = None) -> DataFrame:
    """A day's articles per category as text: how many, and their lines, newest first.

    For callers that show text; :func:`daily_lines` has the same as rows.  Counts
    cover the whole day; a caller may bound the texts to the newest ``listed``.
    """
    rows = daily_articles(engine, day)
    title = _daily_title()
    counts = rows.groupBy("category").agg(F.count("*").alias("articles"))
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("category").orderBy(*_newest())))
    shown = (placed if listed is None else placed.filter(F.col("pos") <= listed)).groupBy("category").agg(
        _lines(["pos"], title).alias("titles"),
        _lines(["pos"], F.concat(title, _daily_note()), "\n\n").alias("listing"),
    )
    return counts.join(shown, "category")


def daily_summaries(engine: Engine, day: str, block: int = briefing.BLOCK) -> DataFrame:
    """One summary per category: generated in parallel tasks, or the title list.

    A category of more than ``block`` articles is summarised in blocks, and the
    blocks' summaries are summarised in turn.  A block whose call fails stands
    with its title list.
    """
    name = render.category_name(F.col("category"))
    failed = F.lit("（摘要生成失败）\n相关报道：\n")
    if engine.generate is None:
        return daily_groups(engine, day).select(
            "category", name.alias("name"), "articles", F.concat(failed, F.col("titles")).alias("summary"))
    from newsloom.functions.providers import GeneratedSummaries

    calls = GeneratedSummaries(engine.generate)

    def combine(category: Column, text: Column, plain: Column) -> Column:
        prompt = F.concat(F.lit("Summarize the day's news for "), render.category_name(category), F.lit(":\n"), text)
        return F.coalesce(F.nullif(X.strip(calls._run(prompt)), F.lit("")), F.concat(failed, plain))

    found = briefing.folded(daily_lines(engine, day), "category", combine, block)
    return found.select("category", name.alias("name"), F.col("n").alias("articles"), F.col("line").alias("summary"))


def daily_report(engine: Engine, target_date: str | None = None, synthesize: bool = False) -> DataFrame:
    """Briefing of one day; sections are ordered by category.

    ``synthesize`` makes one text of the sections by a second pass of the
    generator; where that fails, the sections themselves are the report.
    """
    spark = engine.chunks.sparkSession
    today = F.lit(engine.asof[:10]).cast("date")
    resolved = spark.range(1).select(
        dates.resolve_day(F.lit(target_date or ""), today).alias("day")
    ).select("day", dates.display_day(F.col("day")).alias("shown")).first()
    if resolved["day"] is None:
        return _message(engine, f"日期格式错误: {target_date}，请使用 YYYY-MM-DD 格式。")
    shown = resolved["shown"]
    parts = daily_summaries(engine, resolved["day"].isoformat()).agg(
        F.count("*").alias("n"),
        _lines(["category"], F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.col("summary"), F.lit("\n"))).alias("body"),
    )
    report = F.concat(F.lit(f"# 每日新闻总结 — {shown}\n\n"), F.col("body"))
    if synthesize and engine.generate is not None:
        from newsloom.functions.providers import GeneratedSummaries

        prompt = F.concat(F.lit(f"Write one report of the news of {resolved['day'].isoformat()} from these sections:\n"), F.col("body"))
        made = GeneratedSummaries(engine.generate)._run(F.when(F.col("n") > 0, prompt).otherwise(F.lit("")))
        report = F.coalesce(F.nullif(X.strip(made), F.lit("")), report)
    return parts.select(F.when(F.col("n") == 0, F.lit(f"未找到 {shown} 的新闻文章。")).otherwise(report).alias("report"))
