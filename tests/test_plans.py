"""Shapes of the physical plans that have to hold at scale."""

import contextlib
import io

from pyspark.sql import functions as F

from newsloom.operators import recency, sessions
from newsloom.operators.hybrid import hybrid_search
from newsloom.operators.lexical import keyword_search
from newsloom.operators.ranking import collapse
from newsloom.operators.vector import vector_search
from newsloom.plans import reports
from newsloom.plans.engine import Engine
from newsloom.sources import fixtures as X


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_collapse_limits_groups_before_the_shuffle(spark, sf):
    text = plan(collapse(X.event_rows(spark, sf)))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_recent_pushes_the_window_to_the_scan(spark, sf):
    text = plan(recency.recent_news(X.event_rows(spark, sf), X.ASOF, 24))
    assert "GreaterThanOrEqual(ts" in text and "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_nearest_reads_no_text(spark, sf):
    text = plan(vector_search(X.corpus(spark, sf), [1.0] * 64, 5))
    assert "content:string" not in text and "TakeOrderedAndProject" in text and "Exchange" not in text


def test_searches_have_no_cross_join(spark, sf):
    chunks = X.corpus(spark, sf)
    for df in (
        hybrid_search(chunks, "thin the", [1.0] * 64, 5, columns=["title"]),
        vector_search(chunks, [1.0] * 64, 5, columns=["title", "content"]),
        keyword_search(chunks, "thin the", 5),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Exchange hashpartitioning" not in plan(keyword_search(chunks, "thin the", 5))


def test_display_columns_prune_buckets(spark, sf):
    text = plan(vector_search(X.corpus(spark, sf), [1.0] * 64, 5, columns=["content"]))
    assert "dynamicpruning" in text.lower()


def test_busy_keys_merge_sessions_before_the_shuffle(spark, sf):
    from newsloom.session import tune

    tune(spark)
    text = plan(sessions.activity_sessions(X.table(spark, sf, "events"), "user_id"))
    assert text.count("MergingSessions") >= 2


def test_hot_article_is_collapsed_right(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("article_id"),
        F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), F.col("id").cast("int").alias("chunk_index"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("published_at"),
    )
    top = recency.latest_articles(rows.withColumn("category", F.lit("c")), 3).collect()
    assert [r["chunk_id"] for r in top] == ["c29999", "c29998", "c29997"]
    assert collapse(rows).count() == 20001


def test_daily_groups_list_every_article(spark, sf):
    number = F.col("id").cast("string")
    many = (X.corpus(spark, sf).limit(1).drop("id").crossJoin(spark.range(502)).withColumns({
        "article_id": number, "chunk_id": number, "title": F.concat(F.lit("title "), number), "category": F.lit("tech"),
        "published_at": F.lit("2024-01-05 10:00:00").cast("timestamp")}))
    row = reports.daily_groups(Engine(many.select(X.corpus(spark, sf).columns), X.ASOF), "2024-01-05").first()
    assert row["articles"] == 502
    assert row["titles"].count("「") == row["listing"].count("「title ") == 502


def test_an_index_is_made_for_the_searches_that_read_it(spark, sf):
    made = []
    engine = Engine(X.corpus(spark, sf), X.ASOF, index=lambda: made.append(1))
    engine.semantic("thin the", 2), reports.trend_articles(engine), reports.daily_lines(engine, "2024-01-05")
    assert not made
    engine.index
    assert made
