"""Retrieval by publication time and by article, and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import constants as C
from newsloom.operators import filters
from newsloom.operators.ranking import newest_articles


def recent_news(
    chunks: DataFrame,
    asof: str,
    hours: int = 24,
    limit: int = C.RECENT_LIMIT,
    category: str | None = None,
    exclusive_only: bool = False,
) -> DataFrame:
    """Newest articles of the last ``hours`` before ``asof``, one row each."""
    rows = chunks.filter(filters.since(asof, hours))
    return newest_articles(filters.apply(rows, filters.wanted(category, exclusive_only)), limit)


def articles_by_date(chunks: DataFrame, day: str, limit: int | None = None) -> DataFrame:
    """Articles of one calendar day, one row each: all of them, or the newest ``limit``."""
    return newest_articles(chunks.filter(filters.on_day(day)), limit)


def latest_articles(chunks: DataFrame, limit: int = C.LATEST_LIMIT, category: str | None = None) -> DataFrame:
    """The newest dated articles whatever their age; knows no exclusive filter."""
    rows = chunks.filter(F.col("published_at").isNotNull())
    return newest_articles(filters.apply(rows, filters.wanted(category)), limit)


def chunks_of_article(chunks: DataFrame, article_id: str, limit: int | None = None) -> DataFrame:
    rows = chunks.filter(F.col("article_id") == article_id).orderBy("chunk_index", "chunk_id")
    return rows if limit is None else rows.limit(limit)


def category_terms(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Categories by *chunk* count, largest first, ties by name; null is no category."""
    counts = chunks.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("doc_count"))
    ranked = counts.orderBy(F.col("doc_count").desc(), F.col("category").asc())
    return ranked if limit is None else ranked.limit(limit)


def database_stats(chunks: DataFrame, exact: bool = False) -> DataFrame:
    """One row: chunk and article counts, date range, categories with their counts.

    The article count is a sketch unless ``exact``; the category list is a
    scalar subquery over one row for each category.
    """
    articles = F.count_distinct("article_id") if exact else F.approx_count_distinct("article_id")
    totals = chunks.agg(
        F.count("*").alias("total_chunks"),
        articles.alias("total_articles"),
        F.max("published_at").alias("latest_date"),
        F.min("published_at").alias("oldest_date"),
    )
    ranked = category_terms(chunks).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("doc_count")).alias("order"), "category", "doc_count"
    ))).alias("list"))
    names = ranked.select(F.transform("list", lambda c: F.struct(c["category"], c["doc_count"])))
    return totals.withColumn("categories", names.scalar())
