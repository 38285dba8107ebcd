"""One row per article, top-k and per-group caps.

Every ranked group is cut with ``row_number() <= n`` directly above the window,
which Spark plans as a partial group limit *before* the shuffle: a map task
sends at most ``n`` rows of any group, so one article holding a third of the
corpus does not send a third of the corpus to one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; the rank is kept when it has a name."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def newest_first() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("chunk_index").asc(), F.col("chunk_id").asc()]


def collapse(chunks: DataFrame) -> DataFrame:
    """The newest chunk row of each article."""
    return first_n(chunks, ["article_id"], newest_first(), 1)


def newest_articles(chunks: DataFrame, limit: int | None) -> DataFrame:
    """Collapse, newest first, limit; without a limit every article, unordered.

    A narrow pass over two columns finds the publication time of the
    ``limit``-th newest article; only rows from that moment on are read in full.
    The cutoff is a scalar subquery, so it reaches the scan as a pushed filter.
    """
    if limit is None:
        return collapse(chunks)
    per_article = chunks.groupBy("article_id").agg(F.max("published_at").alias("newest"))
    cutoff = (
        per_article.orderBy(F.col("newest").desc_nulls_last()).limit(limit)
        .agg(F.min("newest").alias("cutoff"))
    )
    rows = chunks.filter(F.col("published_at") >= cutoff.scalar())
    return collapse(rows).orderBy(F.col("published_at").desc_nulls_last(), "article_id").limit(limit)


def best_per_article(hits: DataFrame, limit: int, groups: list[str] = [], rank: str | None = None) -> DataFrame:
    """Highest-scoring chunk per article (and group), best articles first.

    Hits arrive best first, so "order of first appearance" and "order of best
    score" are the same order here.
    """
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    best = first_n(hits, [*groups, "article_id"], order, 1)
    if groups:
        return first_n(best, groups, order, limit, rank)
    top = best.orderBy(*order).limit(limit)
    if rank:  # at most ``limit`` rows are left
        top = top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    return top


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """The row of each key with the smallest position."""
    return first_n(df, [key], [F.col(position).asc()], 1)


def numbered(df: DataFrame, order: list[Column], name: str = "no") -> DataFrame:
    """1-based numbers for a result that a limit has already made small."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
