"""The given tables seen as articles, pages, chunks, messages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions import text as X
from newsloom.operators import enrich
from newsloom.session import scratch_path
from newsloom.sources.chunk_table import ChunkTable

FIRST_MOMENT = "2024-01-01 00:00:00"
ASOF = "2024-01-31 00:00:00"
CRAWLED_AT = "2024-01-31 00:00:00"
SITE_DOMAINS = ["example.com", "example.org", "example.net"]
TITLE_CHARS = 120
# documents are dated along the thirty days that the events cover
MINUTES = 43200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as crawled article records."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("_good"))
    title = F.nullif(F.substring(X.lead(F.col("text"), 1), 1, TITLE_CHARS), F.lit(""))
    published = F.timestamp_add("MINUTE", F.pmod(F.col("doc_id") * 7919, F.lit(MINUTES)), F.lit(FIRST_MOMENT).cast("timestamp_ntz"))
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            F.concat(F.lit("articles/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"),
            "doc_id",
            title.alias("title"),
            F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
            F.col("text").alias("content"),
            F.col("lang").alias("author"),
            F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
            F.lit(None).cast("string").alias("subtitle"),
            F.col("source").alias("category"),
            F.col("source"),
            F.coalesce(F.col("_good"), F.lit(False)).alias("is_exclusive"),
        )
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.sources.articles import clean

    return clean(article_files(spark, sf_dir), "news")


_BUILT: dict[tuple[str, str], str] = {}


def corpus_root(spark: SparkSession, sf_dir: str, buckets: int = 16) -> str:
    """Folder of the chunk table of ``documents``, built once per session.

    It lies below the shared checkpoint folder, so later queries do not depend
    on the executors that produced it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        store = ChunkTable(spark, scratch_path(spark, "corpus"), buckets)
        store.replace_all(enrich.process_articles(articles(spark, sf_dir), F.lit(CRAWLED_AT)))
        _BUILT[key] = store.root
    return _BUILT[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ChunkTable(spark, corpus_root(spark, sf_dir)).read()


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as chunk rows: user = article, event type = category."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("string").alias("article_id"),
        F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("chunk_id"),
        F.col("event_id").cast("int").alias("chunk_index"),
        F.col("event_type").alias("category"),
        (F.col("value") > 50).alias("is_exclusive"),
        F.col("ts").alias("published_at"),
        "value",
    )


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunk rows: label = category, fifty articles."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.md5(F.pmod("vec_id", F.lit(50)).cast("string")).alias("article_id"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("label").cast("string").alias("category"),
        (F.col("label") > 4).alias("is_exclusive"),
        F.col("embedding").alias("content_vector"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chat messages, one minute apart."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as feedback: user = session, rating from the payload."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.lit("0")).alias("message_id"),
        F.col("event_id").alias("seq"),
        (F.pmod(k, F.lit(5)) + 1).alias("rating"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("comment"),
        "ts",
    )
