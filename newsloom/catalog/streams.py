"""Queries answered by running a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query, sql as Q
from newsloom.operators.ranking import first_n
from newsloom.plans.ingest import Indexer
from newsloom.session import is_folder, scratch_path
from newsloom.sources import fixtures as X
from newsloom.sources.chunk_table import ChunkTable
from newsloom.sources.file_log import FileLog
from newsloom.streaming import incremental as I
from newsloom.streaming.expiry import run_expiry


def _stream(spark, sf, name):
    """A given table as a stream; a table is one file or a folder of files."""
    path, schema = f"{sf}/{name}.parquet", X.table(spark, sf, name).schema
    if is_folder(spark, path):
        return I.table_stream(spark, path, schema)
    return I.table_stream(spark, sf, schema, pattern=f"{name}.parquet")


def _event_files(spark, sf, root):
    """``events`` dealt over four files without regard to time, one file per micro-batch."""
    X.table(spark, sf, "events").repartition(4, "event_id").write.parquet(f"{root}/events")
    return I.table_stream(spark, f"{root}/events", spark.read.parquet(f"{root}/events").schema, files_per_batch=1)


@query("stream_index", f"""
WITH {Q.CHUNKS}, c AS (SELECT path, count(*) AS n FROM articles JOIN chunks USING (article_id) GROUP BY path)
SELECT (SELECT count(*) FROM c) AS indexed_files, (SELECT count(*) FROM files) - (SELECT count(*) FROM c) AS failed_files,
  (SELECT sum(n)::BIGINT FROM c) AS total_chunks, (SELECT count(*) FROM chunks) AS stored_chunks""")
def stream_index(spark, sf):
    """Documents written as article records, then indexed file by file."""
    root = scratch_path(spark, "stream-index")
    records = X.article_files(spark, sf)
    records.repartition(4, "path").write.parquet(f"{root}/records")
    schema = spark.read.parquet(f"{root}/records").schema
    files = I.table_stream(spark, f"{root}/records", schema, files_per_batch=2).withColumn(
        "read_error", F.lit(None).cast("string")
    )
    store, log = ChunkTable(spark, f"{root}/chunks", 8), FileLog(spark, f"{root}/log")
    I.index_stream(files, Indexer(spark, store, log), f"{root}/progress", X.CRAWLED_AT).awaitTermination()
    return log.stats().withColumn("stored_chunks", store.read().agg(F.count("*")).scalar())


@query("stream_url_ledger", f"SELECT DISTINCT {Q.normalize_url('url')} AS url FROM pages")
def stream_url_ledger(spark, sf):
    """``pages`` twice over, dealt over four files that come in one by one."""
    root = scratch_path(spark, "stream-urls")
    pages = X.table(spark, sf, "pages").select("url")
    pages.unionAll(pages).repartition(4).write.parquet(f"{root}/in")
    links = I.table_stream(spark, f"{root}/in", pages.schema, files_per_batch=1)
    I.url_ledger_stream(links, f"{root}/ledger", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/ledger").select("url")


@query("stream_hourly_counts", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events
FROM events GROUP BY 1, 2, 3""")
def stream_hourly_counts(spark, sf):
    root = scratch_path(spark, "stream-hours")
    I.count_stream(_event_files(spark, sf, root), ["event_type"], "1 hour", f"{root}/out", f"{root}/progress").awaitTermination()
    return I.merged_counts(spark.read.parquet(f"{root}/out"), ["event_type"])


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS events, min(ts) AS started, max(ts) AS last_event FROM s GROUP BY user_id, n""")
def stream_sessions(spark, sf):
    root = scratch_path(spark, "stream-sessions")
    I.session_stream(_event_files(spark, sf, root), "user_id", f"{root}/out", f"{root}/progress").awaitTermination()
    return I.merged_sessions(spark.read.parquet(f"{root}/out"), "user_id")


@query("stream_history", """
WITH r AS (SELECT conv_id::VARCHAR AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT session_id, count(*) AS kept, min(turn) AS oldest_seq, max(turn) AS newest_seq FROM r WHERE rn <= 4 GROUP BY session_id""")
def stream_history(spark, sf):
    root = scratch_path(spark, "stream-history")
    messages = _stream(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq")
    )
    I.run_updates_to_folder(I.history_stream(messages, 4), f"{root}/out", f"{root}/progress")
    changes = spark.read.parquet(f"{root}/out")
    return first_n(changes, ["session_id"], [F.col("batch").desc()], 1).drop("batch")


@query("stream_merge", """
SELECT ts, 'step' AS type, event_type AS content, NULL::VARCHAR AS detail FROM events WHERE event_type = 'click'
UNION ALL SELECT ts, 'delta', NULL, props FROM events WHERE event_type <> 'click'""")
def stream_merge(spark, sf):
    root = scratch_path(spark, "stream-merge")
    steps = _stream(spark, sf, "events").filter("event_type = 'click'").select(
        "ts", F.lit("step").alias("type"), F.col("event_type").alias("content"))
    deltas = _stream(spark, sf, "events").filter("event_type <> 'click'").select(
        "ts", F.lit("delta").alias("type"), F.col("props").alias("detail"))
    I.run_to_folder(I.merged_stream(steps, deltas), f"{root}/out", f"{root}/progress")
    return spark.read.parquet(f"{root}/out")


@query("stream_expiry", """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY ts DESC, event_id DESC) AS back FROM s)
SELECT user_id::VARCHAR AS session_id, count(*) AS messages, min(ts) AS started, max(ts) AS last_active,
  array_to_string(list(event_id ORDER BY ts, event_id) FILTER (back <= 3), ',') AS kept
FROM k GROUP BY user_id, n
HAVING (epoch_us(max(ts)) + 1800000000) // 1000 + 1 < (SELECT epoch_ms(max(ts)) FROM events) - 600000""")
def stream_expiry(spark, sf):
    """``events`` as messages that arrive in four parts; the stream stops and goes on after each."""
    root = scratch_path(spark, "stream-expiry")
    events = X.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts")
    bounds = events.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    quarter = F.least(F.floor(4 * (F.unix_micros("ts") - F.unix_micros("a")) / (F.unix_micros("z") - F.unix_micros("a") + 1)), F.lit(3))
    placed = events.withColumns({"ts": F.col("ts").cast("timestamp"), "a": bounds.select("a").scalar().cast("timestamp"),
                                 "z": bounds.select("z").scalar().cast("timestamp")}).withColumn("quarter", quarter)
    for k in range(4):
        placed.filter(F.col("quarter") == k).select("session_id", "seq", "ts").write.mode("append").parquet(f"{root}/in")
        files = I.table_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, files_per_batch=1_000_000)
        run_expiry(files, f"{root}/out", f"{root}/progress", limit=3)
    ended = spark.read.parquet(f"{root}/out")
    return ended.withColumns({"kept": F.array_join(F.col("kept").cast("array<string>"), ","),
                              "started": F.col("started").cast("timestamp_ntz"), "last_active": F.col("last_active").cast("timestamp_ntz")})
