"""Statistics of batches against those of the rows themselves."""

from pyspark.sql import functions as F

from newsloom.operators import recency
from newsloom.operators.statistics import BatchStats
from newsloom.plans.ingest import put_chunks, remove_article
from newsloom.sources.chunk_table import ChunkTable


def rows(spark, first, last, category):
    return spark.range(first, last).select(
        F.concat(F.lit("a"), F.floor(F.col("id") / 3)).alias("article_id"), F.lit(category).alias("category"),
        F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("published_at"))


def test_batches_add_up(spark, tmp_path):
    kept = BatchStats(str(tmp_path / "stats"))
    assert tuple(kept.stats(spark).first()) == (0, 0, None, None, [])
    kept.change("v1", rows(spark, 0, 3000, "tech"))
    kept.change("v2", rows(spark, 3000, 3600, None).unionAll(rows(spark, 3600, 4200, "arts")))
    kept.change("v3", rows(spark, 0, 900, "arts"), rows(spark, 0, 900, "tech"))  # three hundred articles change category
    kept.change("v3", rows(spark, 0, 900, "arts"), rows(spark, 0, 900, "tech"))  # the same batch once more
    now = rows(spark, 900, 3000, "tech").unionAll(rows(spark, 3000, 3600, None)).unionAll(rows(spark, 3600, 4200, "arts")).unionAll(
        rows(spark, 0, 900, "arts"))
    got, want = kept.stats(spark).first(), recency.database_stats(now, exact=True).first()
    assert got["total_chunks"] == want["total_chunks"] == 4200
    assert abs(got["total_articles"] - want["total_articles"]) <= 0.03 * 1400
    assert (got["latest_date"], got["oldest_date"], got["categories"]) == (want["latest_date"], want["oldest_date"], want["categories"])
    kept.change("v4", rows(spark, 0, 0, "tech"), rows(spark, 900, 3000, "tech"))
    assert [c["category"] for c in kept.stats(spark).first()["categories"]] == ["arts"]


def test_reading_statistics_touches_no_chunks(spark, tmp_path):
    kept = BatchStats(str(tmp_path / "stats"))
    kept.change("v1", rows(spark, 0, 100_000, "tech"))
    assert kept.read(spark).count() == 1 and len(kept.read(spark).first()["articles"]) < 20_000


def test_statistics_follow_the_chunk_table(spark, tmp_path):
    table, kept = ChunkTable(spark, str(tmp_path / "chunks"), 4), BatchStats(str(tmp_path / "stats"))
    chunks = lambda first, last, category: rows(spark, first, last, category).withColumns({
        "chunk_index": F.lit(0), "chunk_id": F.concat("article_id", F.lit("_"), F.date_format("published_at", "mmss"))})
    put_chunks(table, chunks(0, 60, "tech"), stats=kept)
    put_chunks(table, chunks(30, 90, "arts"), stats=kept)
    remove_article(table, "a29", stats=kept)
    got, want = kept.stats(spark).first(), recency.database_stats(table.read(), exact=True).first()
    assert (got["total_chunks"], got["categories"]) == (want["total_chunks"], want["categories"]) and got["total_chunks"] == 87
    assert got["total_articles"] == 30  # the sketch keeps the article that left
    kept.build(table.read())
    assert kept.stats(spark).first()["total_articles"] == 29
