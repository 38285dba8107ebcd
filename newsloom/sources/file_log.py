"""Append-only record of indexing outcomes.

Each batch appends its rows; nothing is rewritten.  The current ledgers are
aggregations of the log: success clears an earlier failure, failure leaves an
earlier success alone, and a ``cleared`` row forgets all failures before it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators.ledger import ledger_stats
from newsloom.session import path_exists

LOG = "path string, outcome string, article_id string, chunks long, error string, at timestamp_ntz, seq long"


class FileLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All log rows; a log that was never written is empty."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def append(self, results: DataFrame, seq: int | None = None) -> None:
        """Append ``(path, outcome, article_id, chunks, error, at)`` rows."""
        rows = results.withColumn("seq", F.lit(time.time_ns() if seq is None else seq).cast("long"))
        rows.select("path", "outcome", "article_id", F.col("chunks").cast("long"), "error", "at", "seq").write.mode(
            "append"
        ).parquet(self.path)

    def indexed(self) -> DataFrame:
        rows = self.read().filter(F.col("outcome") == "indexed")
        return rows.groupBy("path").agg(
            F.max_by(F.struct("article_id", "chunks", F.col("at").alias("indexed_at")), "seq").alias("r")
        ).select("path", "r.*")

    def failed(self) -> DataFrame:
        at = lambda outcome: F.max(F.when(F.col("outcome") == outcome, F.col("seq")))
        log = self.read()
        cleared = log.agg(F.coalesce(at("cleared"), F.lit(-1)).alias("seq")).scalar()
        failure = F.when(F.col("outcome") == "failed", F.struct("seq", "error", F.col("at").alias("failed_at")))
        rows = log.filter(F.col("outcome").isin("indexed", "failed")).groupBy("path").agg(
            F.max(failure).alias("f"), at("indexed").alias("ok")
        )
        return rows.filter(
            F.col("f").isNotNull() & (F.col("f.seq") > F.coalesce("ok", F.lit(-1))) & (F.col("f.seq") > cleared)
        ).select("path", "f.error", "f.failed_at")

    def clear_failed(self, seq: int | None = None) -> int:
        count = self.failed().count()
        marker = self.spark.createDataFrame(
            [(None, "cleared", None, None, None, None)],
            "path string, outcome string, article_id string, chunks long, error string, at timestamp_ntz",
        )
        self.append(marker, seq)
        return count

    def stats(self) -> DataFrame:
        return ledger_stats(self.indexed(), self.failed())
