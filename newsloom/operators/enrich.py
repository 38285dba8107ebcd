"""Article rows to searchable chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import schemas as S
from newsloom.functions import chunking, providers, urls


def chunk_articles(articles: DataFrame, chunk_tokens: int | None = None, overlap_tokens: int | None = None) -> DataFrame:
    """One row per chunk: article columns, ``chunk_index`` and ``chunk``.

    Chunks are produced inside the article's own task; the result is not
    shuffled.  An article whose text is blank yields no row.
    """
    packed = chunking.chunks(F.col("content"), chunk_tokens, overlap_tokens)
    return articles.select("*", F.posexplode(packed).alias("chunk_index", "chunk"))


def process_articles(
    articles: DataFrame,
    crawled_at: Column,
    embedder: providers.Embedder | None = None,
    summarizer: providers.Summarizer | None = providers.LeadSentences(),
    chunk_tokens: int | None = None,
    overlap_tokens: int | None = None,
    keep: list[str] = [],
) -> DataFrame:
    """Chunk, embed and summarize articles into rows of :data:`schemas.CHUNK`.

    A summary that came with the article wins over a generated one; without a
    summarizer the summaries are empty.
    """
    if summarizer is None:
        article_summary, chunk_summary = F.lit(""), lambda c: F.lit("")
    else:
        article_summary = summarizer.article(F.col("title"), F.col("content"))
        chunk_summary = summarizer.chunk
    article_summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), article_summary)
    rows = chunk_articles(
        articles.withColumn("article_summary", article_summary), chunk_tokens, overlap_tokens
    )
    rows = rows.select(
        *keep,
        "article_id",
        urls.chunk_id(F.col("article_id"), F.col("chunk_index")).alias("chunk_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "title", "url", "source", "category", "author", "subtitle", "is_exclusive", "published_at",
        crawled_at.cast("timestamp_ntz").alias("crawled_at"),
        F.col("chunk").alias("content"),
        "article_summary",
        chunk_summary(F.col("chunk")).alias("chunk_summary"),
        providers.embedding(F.col("chunk"), embedder).alias("content_vector"),
    )
    return rows.select(*keep, *S.CHUNK.fieldNames())


def document_sizes(chunks: DataFrame) -> DataFrame:
    """Chunk count and total chunk length per article."""
    return chunks.groupBy("article_id").agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.length("content")).alias("total_content_length"),
    )
