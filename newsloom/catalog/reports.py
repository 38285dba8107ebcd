"""Queries of the analytical tools."""

from __future__ import annotations


from newsloom import constants as C
from newsloom.catalog import query, sql as Q
from newsloom.catalog.retrieval import OTHER_TEXT, TEXT, _BASE, _engine, _scored
from newsloom.plans import reports as R
from newsloom.plans.engine import Engine
from newsloom.sources import fixtures as X

DAY = "2024-01-05"
HOURS = 240
TOPICS = [TEXT, OTHER_TEXT, "geungunglich stheit"]


def _recent(hours: int) -> str:
    hits = f"hits AS (SELECT * FROM chunks WHERE published_at >= TIMESTAMP '{X.ASOF}' - INTERVAL {hours} HOUR)"
    return f"{Q.CHUNKS}, {hits}{Q.collapsed('hits')}"


_TREND = _recent(HOURS) + """,
placed AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, article_id) AS pos FROM newest),
shares AS (SELECT category, count(*) AS articles, max(published_at) AS newest FROM placed WHERE coalesce(category, '') <> '' GROUP BY category),
topics AS (SELECT row_number() OVER (ORDER BY pos)::INT AS no, title FROM placed WHERE title <> '' ORDER BY pos LIMIT 5)"""


@query("trend_distribution", f"WITH {_TREND} SELECT * FROM shares")
def trend_distribution(spark, sf):
    return R.category_distribution(R.trend_articles(_engine(spark, sf), hours=HOURS))


@query("trend_topics", f"WITH {_TREND} SELECT * FROM topics")
def trend_topics(spark, sf):
    return R.title_topics(R.trend_articles(_engine(spark, sf), hours=HOURS), 5)


@query("trend_report", f"""
WITH {_TREND} SELECT '=== 新闻趋势分析报告 ===' || chr(10) || '时间范围: 最近 {HOURS} 小时' || chr(10) || '文章总数: ' || (SELECT count(*) FROM placed) || ' 篇'
  || chr(10) || chr(10) || '--- 分类分布 ---' || chr(10)
  || (SELECT string_agg('  - ' || category || ': ' || articles || ' 篇', chr(10) ORDER BY articles DESC, newest DESC, category) FROM shares)
  || chr(10) || chr(10) || '--- 热门话题 Top 5 ---' || chr(10) || '  (基于标题的前 5 条新闻)' || chr(10)
  || (SELECT string_agg('  ' || no || '. ' || title, chr(10) ORDER BY no) FROM topics) || chr(10) AS report""")
def trend_report(spark, sf):
    return R.trend_report(_engine(spark, sf), hours=HOURS)


def _topic(i: int, text: str, fetch: int) -> str:
    name = f"q{i}"
    return Q.hybrid(text, fetch, C.TOOL_WEIGHTS, name=name) + f""",
{name}_top AS (SELECT '{text}' AS topic, * FROM {name})"""


def _ranked(texts: list[str], fetch: int, keep: int) -> str:
    parts = "".join(_topic(i, t, fetch) for i, t in enumerate(texts))
    union = " UNION ALL ".join(f"SELECT * FROM q{i}_top" for i in range(len(texts)))
    return f"""{_BASE}{parts},
every AS ({union}),
best AS (SELECT *, row_number() OVER (PARTITION BY topic, article_id ORDER BY score DESC, chunk_id) AS rn FROM every),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, chunk_id)::INT AS rank FROM best WHERE rn = 1),
picked AS (SELECT * FROM ranked WHERE rank <= {keep})"""


@query("compare_topics", f"""
WITH {_ranked(TOPICS, 6, 3)}
SELECT p.topic, p.rank, p.article_id, round(p.score, 6) AS score, c.title, c.article_summary AS summary, c.published_at FROM picked p JOIN chunks c USING (chunk_id)""")
def compare_topics(spark, sf):
    rows = R.compare_topics(_engine(spark, sf), TOPICS, 3)
    return _scored(rows, "topic", "rank", "article_id", "title", "summary", "published_at")


_ANGLES = [f"{TEXT} {suffix}".strip() for suffix in (
    "", "market impact economic implications", "policy regulation government response",
    "industry trend outlook future development",
)]


@query("research_articles", f"""
WITH {_ranked(_ANGLES, 6, 3)},
merged AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS again FROM picked),
final AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS no FROM merged WHERE again = 1)
SELECT f.no, f.article_id, f.chunk_id, round(f.score, 6) AS score, c.title, c.url FROM final f JOIN chunks c USING (chunk_id) WHERE f.no <= 10""")
def research_articles(spark, sf):
    rows = R.research_articles(_engine(spark, sf), TEXT, 10)
    return _scored(rows, "no", "article_id", "chunk_id", "title", "url")


@query("compare_report", f"""
WITH {_ranked(TOPICS, 6, 3)},
asked AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TOPICS))}) t(place, topic)),
parts AS (SELECT topic, count(*) AS n,
  string_agg('- ' || title || chr(10) || '  ' || summary, chr(10) ORDER BY rank) AS brief,
  string_agg('[' || rank || '] ' || title || chr(10) || '    Published: ' || strftime(published_at, '%Y-%m-%dT%H:%M:%S')
    || chr(10) || '    Category: ' || category || chr(10) || '    URL: ' || url || chr(10) || '    Summary: ' || summary || chr(10), chr(10) ORDER BY rank) AS detail
  FROM (SELECT p.topic, p.rank, c.title, c.article_summary AS summary, c.published_at, c.category, c.url FROM picked p JOIN chunks c USING (chunk_id)) GROUP BY topic)
SELECT '=== 多主题对比分析报告 ===' || chr(10) || '主题: {', '.join(TOPICS)}' || chr(10) || chr(10) || '## 对比分析（LLM 生成失败，以下为原始数据摘要）' || chr(10) || chr(10)
  || string_agg('### ' || topic || chr(10) || coalesce(brief, '- No articles found') || chr(10), chr(10) ORDER BY place)
  || chr(10) || chr(10) || '=== 原始文章数据 ===' || chr(10)
  || string_agg(chr(10) || '--- ' || topic || ' (' || coalesce(n, 0) || ' articles) ---' || chr(10) || coalesce(detail, 'No articles found.'), chr(10) ORDER BY place) AS report
FROM asked LEFT JOIN parts USING (topic)""")
def compare_report(spark, sf):
    return R.compare_report(_engine(spark, sf), ",".join(TOPICS))


@query("research_report", f"""
WITH {_ranked(_ANGLES, 6, 3)},
merged AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS again FROM picked),
final AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS no FROM merged WHERE again = 1),
f AS (SELECT no, title, article_summary AS summary, c.category, c.published_at, url FROM final JOIN chunks c USING (chunk_id) WHERE no <= 10)
SELECT '# 深度研究报告：{TEXT}' || chr(10) || '*基于 ' || count(*) || ' 篇相关文章的多角度分析*' || chr(10) || chr(10) || '## 概述' || chr(10)
  || '以下是关于「{TEXT}」的相关新闻汇总（共 ' || count(*) || ' 篇）。' || chr(10) || chr(10) || '## 相关文章摘要' || chr(10)
  || string_agg(no || '. 「' || title || '」：' || summary, chr(10) ORDER BY no) || chr(10) || chr(10)
  || '*注：由于分析服务暂时不可用，仅提供文章摘要。*' || chr(10) || chr(10) || '---' || chr(10) || '## 参考文章' || chr(10)
  || string_agg(no || '. 「' || title || '」 [' || category || '] (' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || ')' || chr(10) || '   ' || url, chr(10) ORDER BY no) AS report FROM f""")
def research_report(spark, sf):
    return R.research_report(_engine(spark, sf), TEXT)


@query("news_query_report")
def news_query_report(spark, sf):
    return _engine(spark, sf).tool("news_query", query=f"summarize {TEXT}", max_results=4)


@query("database_latest", f"""
WITH {Q.CHUNKS}, hits AS (SELECT * FROM chunks WHERE published_at IS NOT NULL AND category = 'src4'){Q.collapsed('hits', 5)},
n AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, article_id) AS no FROM newest)
SELECT '=== 最新 ' || count(*) || ' 篇文章 ===' || chr(10) || chr(10) || string_agg(
  no || '. 「' || title || '」' || chr(10) || '   分类: ' || category || ' | 发布: ' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || chr(10)
  || '   URL: ' || url || CASE WHEN article_summary <> '' THEN chr(10) || '   摘要: ' || substring(article_summary, 1, 150) || '...' ELSE '' END || chr(10),
  chr(10) ORDER BY no) AS report FROM n""")
def database_latest(spark, sf):
    return R.database_info(_engine(spark, sf), "latest", "src4")


_SHARES = f"""
WITH {Q.CHUNKS}, terms AS (SELECT category, count(*) AS n FROM chunks WHERE category IS NOT NULL GROUP BY category),
shares AS (SELECT string_agg('  ' || category || ': ' || n || ' 条记录', chr(10) ORDER BY n DESC, category) AS list FROM terms)"""


@query("database_categories", _SHARES + """
SELECT '=== 分类分布 (共 ' || count(DISTINCT article_id) || ' 篇文章) ===' || chr(10) || chr(10) || (SELECT list FROM shares) AS report FROM chunks""")
def database_categories(spark, sf):
    return R.database_info(_engine(spark, sf), "categories", exact=True)


@query("database_overview", _SHARES + """
SELECT '=== 数据库统计 ===' || chr(10) || '总文章数: ' || count(DISTINCT article_id) || chr(10) || '总分块数: ' || count(*)
  || chr(10) || '最新文章日期: ' || strftime(max(published_at), '%Y-%m-%dT%H:%M:%S') || chr(10) || '最早文章日期: ' || strftime(min(published_at), '%Y-%m-%dT%H:%M:%S')
  || chr(10) || chr(10) || '分类分布:' || chr(10) || (SELECT list FROM shares) AS report FROM chunks""")
def database_overview(spark, sf):
    # an unknown question means the overview
    return R.database_info(_engine(spark, sf), "anything", exact=True)


_DAY = Q.CHUNKS + f""",
hits AS (SELECT * FROM chunks WHERE published_at >= DATE '{DAY}' AND published_at < DATE '{DAY}' + 1){Q.collapsed('hits')},
placed AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, article_id) AS pos FROM newest),
groups AS (SELECT category, count(*) AS articles, string_agg('- 「' || title || '」', chr(10) ORDER BY pos) AS titles,
  string_agg('- 「' || title || '」' || CASE WHEN article_summary <> '' THEN chr(10) || '  摘要: ' || article_summary ELSE chr(10) || '  内容: ' || substring(content, 1, 300) END, chr(10) || chr(10) ORDER BY pos) AS listing
  FROM placed GROUP BY category)"""


@query("daily_groups", f"WITH {_DAY} SELECT * FROM groups")
def daily_groups(spark, sf):
    return R.daily_groups(_engine(spark, sf), DAY)


@query("daily_lines", f"""
WITH {_DAY} SELECT category, row_number() OVER (PARTITION BY category ORDER BY pos) AS pos, article_id, '- 「' || title || '」' AS plain,
  '- 「' || title || '」' || CASE WHEN article_summary <> '' THEN chr(10) || '  摘要: ' || article_summary ELSE chr(10) || '  内容: ' || substring(content, 1, 300) END AS line
FROM placed""")
def daily_lines(spark, sf):
    return R.daily_lines(_engine(spark, sf), DAY)


@query("daily_digest", f"""
WITH {_DAY} SELECT category, count(*) AS n, '- 「' || first(title ORDER BY pos) || '」 … - 「' || last(title ORDER BY pos) || '」' AS line
FROM placed GROUP BY category""")
def daily_digest(spark, sf):
    # blocks of three, so that the fold has several levels on small tables too
    return R.daily_digest(_engine(spark, sf), DAY, 3)


@query("daily_report", f"""
WITH {_DAY} SELECT '# 每日新闻总结 — 2024年1月5日（星期五）' || chr(10) || chr(10) || string_agg(
  '## ' || category || chr(10) || '（摘要生成失败）' || chr(10) || '相关报道：' || chr(10) || titles || chr(10), chr(10) ORDER BY category) AS report FROM groups""")
def daily_report(spark, sf):
    return R.daily_report(_engine(spark, sf), DAY)


@query("daily_empty", "SELECT '未找到 2031年3月4日（星期二） 的新闻文章。' AS report FROM (SELECT count(*) FROM documents)")
def daily_empty(spark, sf):
    return R.daily_report(Engine(X.corpus(spark, sf), X.ASOF), "2031-03-04")
