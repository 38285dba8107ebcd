"""What has been indexed, what failed, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.urls import normalize_url


def pending(files: DataFrame, indexed: DataFrame, failed: DataFrame, include_failed: bool = False) -> DataFrame:
    """Files not indexed and, unless asked for, not failed either."""
    todo = files.join(indexed.select("path"), "path", "left_anti")
    if not include_failed:
        todo = todo.join(failed.select("path"), "path", "left_anti")
    return todo


def record(indexed: DataFrame, failed: DataFrame, done: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledgers after a batch.

    Success clears an earlier failure; failure leaves an earlier success alone.
    """
    new_indexed = indexed.join(done.select("path"), "path", "left_anti").unionByName(done)
    new_failed = (
        failed.join(done.select("path"), "path", "left_anti")
        .join(broken.select("path"), "path", "left_anti").unionByName(broken)
    )
    return new_indexed, new_failed


def ledger_stats(indexed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: indexed files, failed files, chunks of the indexed files."""
    both = indexed.select(F.lit(1).alias("ok"), "chunks").unionByName(
        failed.select(F.lit(0).alias("ok"), F.lit(0).cast("long").alias("chunks"))
    )
    return both.agg(
        F.coalesce(F.sum("ok"), F.lit(0)).alias("indexed_files"),
        F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("failed_files"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"),
    )


def batch_rollup(results: DataFrame, *groups: str) -> DataFrame:
    """Indexed, skipped and failed files, chunks and, where ``seconds`` are known, seconds per file."""
    timed = [F.avg("seconds").alias("seconds_per_file")] if "seconds" in results.columns else []
    return results.groupBy(*groups).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("outcome") == "indexed").alias("indexed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "indexed", F.col("chunks"))), F.lit(0)).alias("total_chunks"),
        *timed,
    )


def url_ledger(urls: DataFrame) -> DataFrame:
    """Distinct normalized URLs."""
    return urls.select(normalize_url(F.col("url")).alias("url")).distinct()


def new_links(links: DataFrame, crawled: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Links whose normalized URL is in neither ledger."""
    known = crawled.select("url")
    if skipped is not None:
        known = known.union(skipped.select("url"))
    known = known.withColumnRenamed("url", "clean_url")
    return links.withColumn("clean_url", normalize_url(F.col("url"))).join(known, "clean_url", "left_anti")


def url_changes(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose URL would change when normalized."""
    clean = normalize_url(F.col("url"))
    return rows.select(key, F.col("url").alias("original"), clean.alias("cleaned")).filter(
        F.col("original") != F.col("cleaned")
    )


def url_change_stats(rows: DataFrame, applied: Column | None = None, broken: Column | None = None) -> DataFrame:
    """Counts of a URL rewrite; rows without a URL count only in the total."""
    changed = F.coalesce(F.col("url") != normalize_url(F.col("url")), F.lit(False))
    applied = F.lit(False) if applied is None else applied
    counts = [
        F.count("*").alias("total"),
        F.count_if(changed).alias("needs_update"),
        F.count_if(changed & applied).alias("updated"),
    ]
    if broken is not None:
        counts.append(F.count_if(broken).alias("errors"))
    return rows.agg(*counts)
