"""Corpus statistics kept as one small row per batch and category, so asking reads no chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.session import path_exists, remove_path, stored

SKETCH_BITS = 14   # 2^14 registers, at most some 16 KB a row; standard deviation 0.8 %
COLUMNS = "category string, chunks long, articles binary, oldest timestamp_ntz, latest timestamp_ntz, batch string"


def batch_stats(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``category, chunks, articles, oldest, latest`` of a batch of chunks.

    ``removed`` are the stored rows that the batch replaces: their number counts
    negative.  Sketches and bounds cannot give anything back, so an article that
    leaves for good, or a bound that only it held, stays until the next build.
    """
    rows = added.groupBy("category").agg(
        F.count("*").alias("chunks"), F.hll_sketch_agg("article_id", SKETCH_BITS).alias("articles"),
        F.min("published_at").alias("oldest"), F.max("published_at").alias("latest"))
    if removed is None:
        return rows
    gone = removed.groupBy("category").agg((-F.count("*")).alias("chunks"))
    return rows.unionByName(gone, allowMissingColumns=True)


class BatchStats:
    """Statistics rows below ``root``, a folder for each batch; a batch that is repeated replaces its own."""

    def __init__(self, root: str):
        self.root = root

    def exists(self, spark: SparkSession) -> bool:
        return path_exists(spark, self.root)

    def build(self, chunks: DataFrame) -> None:
        """One batch made of all rows, in place of those before."""
        rows = stored(batch_stats(chunks), "stats")
        remove_path(chunks.sparkSession, self.root)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch=all")

    def change(self, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Add what a batch adds and takes away."""
        added = removed.limit(0) if added is None else added
        batch_stats(added, removed).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.exists(spark):
            return spark.createDataFrame([], COLUMNS)
        return spark.read.schema(COLUMNS).parquet(self.root)

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row, as ``recency.database_stats`` returns it; articles are an estimate."""
        return merged_stats(self.read(spark))


def merged_stats(rows: DataFrame) -> DataFrame:
    """All batches together: categories are folded first, then the one row of the corpus."""
    by_category = rows.groupBy("category").agg(
        F.sum("chunks").alias("chunks"), F.hll_union_agg("articles").alias("articles"),
        F.min("oldest").alias("oldest"), F.max("latest").alias("latest"))
    counted = F.when(F.col("category").isNotNull() & (F.col("chunks") > 0),
                     F.struct((-F.col("chunks")).alias("order"), "category", F.col("chunks").alias("doc_count")))
    listed = F.transform(F.sort_array(F.collect_list(counted)), lambda c: F.struct(c["category"], c["doc_count"]))
    return by_category.agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("articles")), F.lit(0)).alias("total_articles"),
        F.max("latest").alias("latest_date"), F.min("oldest").alias("oldest_date"), listed.alias("categories"))
