"""Row filters shared by the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import constants as C


def wanted(category: str | None = None, exclusive_only: bool = False) -> Column | None:
    """Category and exclusivity conditions; ``None`` when there are none."""
    condition = None
    if category:
        condition = F.col("category") == category
    if exclusive_only:
        exclusive = F.col("is_exclusive")
        condition = exclusive if condition is None else condition & exclusive
    return condition


def apply(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.filter(condition)


def since(asof: str, hours: int) -> Column:
    """Published at most ``hours`` before ``asof``; later rows pass as well."""
    start = F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return F.col("published_at") >= start


def on_day(day: str) -> Column:
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    return (F.col("published_at") >= start) & (F.col("published_at") < end)


def article_error(title: Column, content: Column, url: Column) -> Column:
    """Why an article record (of stripped fields) is unusable, or null; the
    first problem counts."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(empty(title), F.lit("Missing title"))
        .when(empty(content), F.lit("Missing content"))
        .when(
            F.length(content) < C.MIN_CONTENT_CHARS,
            F.concat(F.lit("Content too short ("), F.length(content).cast("string"), F.lit(" chars)")),
        )
        .when(empty(url), F.lit("Missing URL"))
    )


def valid_rating(rating: Column) -> Column:
    return F.coalesce(rating.between(1, 5), F.lit(False))
