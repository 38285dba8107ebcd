"""Batch indexing of article files and maintenance of what is stored."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions import providers
from newsloom.operators import enrich, ledger
from newsloom.operators.lexical import PostingTable
from newsloom.operators.ranking import first_n
from newsloom.operators.statistics import BatchStats
from newsloom.sources import articles as A
from newsloom.sources.chunk_table import ChunkTable
from newsloom.sources.file_log import FileLog


def put_chunks(table: ChunkTable, chunks: DataFrame, mode: str = "chunk", order: str | None = None,
               index: PostingTable | None = None, stats: BatchStats | None = None) -> dict:
    """:meth:`ChunkTable.upsert`, the posting table and the statistics changed along with it.

    The rows that are replaced are read from the buckets that ``chunks`` falls into.
    Postings and statistics are written first, under the version the table is about to
    get: a call that dies in between and is made again writes the same batch in its place.
    """
    beside = [b for b in (index, stats) if b is not None]
    kept = [b for b in beside if table.exists() and b.exists(table.spark)]
    if kept:
        added = chunks if order is None else first_n(chunks, ["chunk_id"], [F.col(order).desc()], 1)
        names = ["bucket", "article_id"] + (["chunk_id"] if mode == "chunk" else [])
        removed = _rows_of(table, added, names)
        for one in kept:
            one.change(_next_version(table), added, removed)
    done = table.upsert(chunks, mode, order)
    for one in beside:
        if one not in kept:
            one.build(table.read())
    return done


def remove_article(table: ChunkTable, article_id: str, index: PostingTable | None = None, stats: BatchStats | None = None) -> int:
    """:meth:`ChunkTable.delete_article`, its postings and counts taken back too."""
    for one in (index, stats):
        if one is not None and one.exists(table.spark) and table.exists():
            asked = table.spark.createDataFrame([(article_id,)], "article_id string")
            one.change(_next_version(table), removed=_rows_of(table, asked, ["bucket", "article_id"]))
    return table.delete_article(article_id)


def _next_version(table: ChunkTable) -> str:
    return f"v{table.version() + 1}"


def _rows_of(table: ChunkTable, rows: DataFrame, names: list[str]) -> DataFrame:
    """Stored chunks with the keys of ``rows``; the filter makes Spark prune the buckets."""
    keys = table.bucketed(rows).select(names).filter(F.col("bucket") >= 0).distinct()
    return table.read().join(keys, names, "left_semi")


class Indexer:
    """Files -> clean articles -> chunks -> table, with a log of outcomes.

    A batch is a handful of Spark jobs whatever the number of files: the
    articles of all pending files are chunked, embedded and summarized in
    parallel tasks, and one table commit makes them visible.
    """

    def __init__(
        self,
        spark: SparkSession,
        table: ChunkTable,
        log: FileLog,
        default_source: str = "news",
        embedder: providers.Embedder | None = None,
        summarizer: providers.Summarizer | None = providers.LeadSentences(),
        chunk_tokens: int | None = None,
        overlap_tokens: int | None = None,
        index: PostingTable | None = None,
        stats: BatchStats | None = None,
    ) -> None:
        self.spark, self.table, self.log, self.index, self.kept_stats = spark, table, log, index, stats
        self.chunk_tokens, self.overlap_tokens = chunk_tokens, overlap_tokens
        self.default_source, self.embedder, self.summarizer = default_source, embedder, summarizer

    def pending(self, directory: str, include_failed: bool = False) -> DataFrame:
        """Pending article records; their content is only read past this join."""
        files = A.read_article_files(self.spark, directory)
        return ledger.pending(files, self.log.indexed(), self.log.failed(), include_failed)

    def dry_run(self, directory: str, limit: int = 20) -> DataFrame:
        return self.pending(directory).select("path").orderBy("path").limit(limit)

    def index_files(self, files: DataFrame, asof: str, seq: int | None = None) -> DataFrame:
        """Index the given records; returns ``(path, outcome, article_id, chunks, error, at, seconds)``.

        Unusable records and records without a chunk are logged as failed and
        do not stop the batch.  Files of a batch are worked on side by side, so
        ``seconds`` is each one's share of the batch's time.
        """
        started = time.monotonic()
        staged = f"{self.table.root}/staged/{uuid.uuid4().hex}"
        checked = A.check_records(files)
        good = A.to_articles(checked, self.default_source, keep=["path"])
        chunks = enrich.process_articles(
            good, F.lit(asof), self.embedder, self.summarizer, self.chunk_tokens, self.overlap_tokens, keep=["path"]
        )
        # chunks are needed twice (table and log): compute them once
        chunks.write.parquet(staged)
        chunks = self.spark.read.parquet(staged)
        # files in path order: of two files with one URL the later one wins
        put_chunks(self.table, chunks, order="path", index=self.index, stats=self.kept_stats)
        done = chunks.groupBy("path").agg(F.min("article_id").alias("article_id"), F.count("*").alias("chunks"))
        results = checked.select("path", "problem").join(done, "path", "left").select(
            "path",
            F.when(F.col("chunks").isNull(), "failed").otherwise("indexed").alias("outcome"),
            "article_id",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("problem", F.when(F.col("chunks").isNull(), F.lit("Article produced no chunks"))).alias("error"),
            F.lit(asof).cast("timestamp_ntz").alias("at"),
        )
        outcome = f"{self.table.root}/staged/{uuid.uuid4().hex}"
        results.write.parquet(outcome)
        results = self.spark.read.parquet(outcome)
        self.log.append(results, seq)
        return results.withColumn("seconds", F.lit((time.monotonic() - started) / max(results.count(), 1)))

    def index_directory(self, directory: str, asof: str, include_failed: bool = False) -> DataFrame:
        return self.index_files(self.pending(directory, include_failed), asof)

    def index_path(self, path: str, asof: str, force: bool = False) -> DataFrame:
        """Index one file; an indexed one is skipped unless forced."""
        files = A.read_article_files(self.spark, path)
        if not force:
            files = files.join(self.log.indexed().select("path"), "path", "left_anti")
        return self.index_files(files, asof)

    def clear_failed(self) -> int:
        return self.log.clear_failed()

    def stats(self) -> DataFrame:
        return self.log.stats()


def rewrite_urls(spark: SparkSession, source: str, target: str, apply: bool = False) -> DataFrame:
    """Normalize the URL of every article file; returns one row of counts.

    Without ``apply`` nothing is written.  The cleaned records go to a new
    folder, since Spark must not overwrite what it reads.
    """
    from newsloom.functions.urls import normalize_url

    files = A.read_article_files(spark, source)
    if apply:
        cleaned = files.filter(F.col("read_error").isNull()).withColumn("url", normalize_url(F.col("url")))
        cleaned.drop("path", "read_error").write.mode("errorifexists").json(target)
    return ledger.url_change_stats(files, F.lit(apply), F.col("read_error").isNotNull())


def write_articles(articles: DataFrame, target: str) -> None:
    """Article records as JSON below ``category=/day=`` folders."""
    articles.write.mode("append").partitionBy("category", "day").option("ignoreNullFields", "false").json(target)
