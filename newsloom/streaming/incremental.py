"""Continuous indexing, URL ledger, chat sessions and counts.

All streams run with ``availableNow`` or a processing-time trigger of the
caller's choice.  Folders below the checkpoint hold the progress, so a stopped
stream continues where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from newsloom import constants as C
from newsloom import schemas as S
from newsloom.functions import urls
from newsloom.operators.sessions import activity_sessions
from newsloom.plans.ingest import Indexer


def table_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 5, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a few files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def article_stream(spark: SparkSession, directory: str, files_per_batch: int = 5) -> DataFrame:
    """Article files as they appear; Spark remembers which ones it has read."""
    rows = (
        spark.readStream.schema(StructType([*S.ARTICLE_FILE.fields, StructField("_corrupt", S.STRING)]))
        .option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(directory)
    )
    path = urls.unix_path(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/"))
    return rows.select(
        path.alias("path"), *S.ARTICLE_FILE.fieldNames(),
        F.when(F.col("_corrupt").isNotNull(), F.lit("Invalid JSON")).alias("read_error"),
    )


def index_stream(articles: DataFrame, indexer: Indexer, checkpoint: str, asof: str) -> StreamingQuery:
    """Index each micro-batch into the chunk table and the file log.

    A batch that is repeated after a failure writes the same chunk ids again,
    so the table ends up the same.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            indexer.index_files(batch, asof)  # the log orders batch and stream runs by one clock

    return (
        articles.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def new_urls(links: DataFrame) -> DataFrame:
    """``url``: the normalized URLs of a stream that are new to it; a row without URL has none.

    A URL that was met is a key of the stream's state, so a micro-batch looks up
    its own URLs and never reads the ledger.  Each Arrow batch is made distinct
    first, so a URL that a third of all rows name is not shuffled row by row.
    """
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.unique(batch.column(0))], names=["url"])

    clean = links.select(urls.normalize_url(F.col("url")).alias("url")).filter(F.col("url").isNotNull())
    return clean.mapInArrow(distinct, "url string").dropDuplicates(["url"])


def url_ledger_stream(links: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Append normalized URLs not seen before, in this run or an earlier one.

    The state lies in RocksDB below ``checkpoint``; the file sink counts a batch
    that is repeated after a failure once.
    """
    spark = links.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a stream keeps the store it was started with
    try:
        return (
            new_urls(links).writeStream.outputMode("append").format("parquet").option("path", ledger)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def folded_stream(events: DataFrame, fold: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch and store the result as one ``batch=`` folder.

    Nothing waits for a watermark, so late rows count and open windows are there
    at once; a repeated batch replaces its folder.  Readers combine the folders
    with :func:`merged_sessions` or :func:`merged_counts`.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def session_stream(
    events: DataFrame, key: str, target: str, checkpoint: str, minutes: int = C.SESSION_TTL_MINUTES
) -> StreamingQuery:
    """Activity runs per key and micro-batch."""
    return folded_stream(events, lambda batch: activity_sessions(batch, key, minutes), target, checkpoint)


def merged_sessions(pieces: DataFrame, key: str, minutes: int = C.SESSION_TTL_MINUTES) -> DataFrame:
    """Activity runs from the pieces of all micro-batches, in whatever order they came.

    Pieces whose gap is at most ``minutes`` belong together.
    """
    before = Window.partitionBy(key).orderBy("started", "last_event").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("last_event").over(before)
    apart = reached.isNull() | (F.col("started") > reached + F.make_dt_interval(mins=F.lit(minutes)))
    upto = Window.partitionBy(key).orderBy("started", "last_event").rowsBetween(Window.unboundedPreceding, 0)
    runs = pieces.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(upto))
    return runs.groupBy(key, "_run").agg(
        F.sum("events").alias("events"), F.min("started").alias("started"), F.max("last_event").alias("last_event")
    ).drop("_run")


def count_stream(
    events: DataFrame, keys: list[str], width: str, target: str, checkpoint: str, slide: str | None = None
) -> StreamingQuery:
    """Tumbling or sliding window counts per key and micro-batch."""
    def fold(batch: DataFrame) -> DataFrame:
        window = F.window("ts", width, slide) if slide else F.window("ts", width)
        rows = batch.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"))
        return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events")

    return folded_stream(events, fold, target, checkpoint)


def merged_counts(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Window counts over all micro-batches."""
    return pieces.groupBy("window_start", "window_end", *keys).agg(F.sum("events").alias("events"))


HISTORY_OUT = "session_id string, kept long, oldest_seq long, newest_seq long"
HISTORY_STATE = "seqs array<bigint>"


def bounded_history(limit: int = C.SESSION_MESSAGE_LIMIT):
    """State function: the last ``limit`` message numbers of each session.

    The state never holds more than ``limit`` numbers; rows of a batch arrive in
    Arrow pieces and are folded in piece by piece.
    """
    def update(key, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs = list(state.get[0]) if state.exists else []
        for piece in pieces:
            seqs = sorted({*seqs, *(int(v) for v in piece["seq"])})[-limit:]
        state.update((seqs,))
        yield pd.DataFrame({
            "session_id": [key[0]], "kept": [len(seqs)], "oldest_seq": [seqs[0]], "newest_seq": [seqs[-1]],
        })

    return update


def history_stream(messages: DataFrame, limit: int = C.SESSION_MESSAGE_LIMIT) -> DataFrame:
    """Changelog of each session's bounded history."""
    return messages.select("session_id", "seq").groupBy("session_id").applyInPandasWithState(
        bounded_history(limit), HISTORY_OUT, HISTORY_STATE, "update", GroupStateTimeout.NoTimeout
    )


def merged_stream(progress: DataFrame, deltas: DataFrame) -> DataFrame:
    """Events of two producers as one stream."""
    columns = list(dict.fromkeys([*progress.columns, *deltas.columns]))
    fill = lambda df: df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns
    ])
    return fill(progress).union(fill(deltas))


def run_to_folder(rows: DataFrame, target: str, checkpoint: str, partition: list[str] = []) -> None:
    """Drain an append-mode stream into Parquet."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", target)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_updates_to_folder(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Drain an update-mode stream; each micro-batch is one ``batch=`` folder."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    (
        rows.writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
