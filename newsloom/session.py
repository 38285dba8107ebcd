"""Session construction and the few runtime settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Settings that only change how a plan runs, never what it returns.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # cut "first n of each key" before the shuffle for any n in use here
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # merge one user's sessions inside each map task before the shuffle, so a
    # user with a third of all events does not ship every event to one reducer
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Arrow batches of whole texts: without a bound a task's Python holds ten thousand documents, with its words, at once.
TEXT_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession, batches: Mapping[str, str] = {}) -> SparkSession:
    """Apply :data:`RUNTIME_CONF`, and bounds of Arrow batches if given, to a session somebody else built."""
    for key, value in {**RUNTIME_CONF, **batches}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session for scripts and tests; a cluster supplies its own master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **TEXT_BATCHES, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder (all
    "executors" share the machine); a cluster session without it is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix=f"newsloom-{os.getpid()}-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below :func:`shared_dir` that nothing has used before."""
    return f"{shared_dir(spark)}/newsloom/{label}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory())


def remove_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; False when there was none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` by way of a table in the shared folder: computed once, with no lineage to lose."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
