"""The stored chunk table: Parquet, bucketed by article, with small deltas on top.

Base rows live in folders ``rows/commit=<id>/bucket=<b>``; a change is a folder
``deltas/commit=<id>`` with the rows it puts and the articles it kills, each with
the version that wrote it.  A numbered snapshot file names the base commit of
each bucket and the deltas; the highest number is the current table.  A change
therefore costs what it writes, not the buckets it falls into, a reader sees
either the old or the new table, a job that dies half-way leaves only folders
nobody points to, and of two writers that race for a number one fails.

Reading puts the last version of each chunk over the base: the base is anti-joined
with the keys of the deltas, which are small and usually broadcast.  Deltas are
folded into one when there are many, and :meth:`ChunkTable.compact` folds them
into the base.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from newsloom import schemas as S
from newsloom.operators.ranking import first_n

MAX_DELTAS = 16             # deltas before they are folded into one


class ChunkTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, schema: StructType = S.CHUNK):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = schema

    # --- snapshots --------------------------------------------------------------
    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """Number of the current snapshot, 0 when there is none."""
        fs, folder = self._fs("snapshots")
        if not fs.exists(folder):
            return 0
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _snapshot(self) -> dict | None:
        version = self.version()
        if not version:
            return None
        return self._load(f"{version:012d}.json")

    def _load(self, name: str) -> dict:
        fs, path = self._fs(f"snapshots/{name}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, snapshot: dict) -> None:
        version = snapshot.get("version", 0) + 1
        fs, final = self._fs(f"snapshots/{version:012d}.json")
        fs.mkdirs(final.getParent())
        try:
            out = fs.create(final, False)  # of two writers one finds the file there
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            raise RuntimeError(f"another writer published version {version} of {self.root}") from error
        out.write(bytearray(json.dumps({**snapshot, "version": version}).encode()))
        out.close()

    # --- lifecycle ----------------------------------------------------------------
    def exists(self) -> bool:
        return self._snapshot() is not None

    def create(self, recreate: bool = False) -> str:
        """``created`` or ``exists``; ``recreate`` empties an existing table."""
        if self.exists() and not recreate:
            return "exists"
        self._publish({
            "version": self.version(), "buckets": self.buckets, "live": {}, "deltas": [],
            "schema": json.loads(self.schema.json()),
        })
        return "created"

    def drop(self) -> bool:
        """Forget the table's rows; False when there was no table."""
        fs, folder = self._fs("snapshots")
        return bool(fs.exists(folder) and fs.delete(folder, True))

    def missing_fields(self) -> list[str]:
        """Expected columns the stored table does not have yet."""
        snapshot = self._snapshot()
        if snapshot is None:
            return self.schema.fieldNames()
        have = {f["name"] for f in snapshot["schema"]["fields"]}
        return [name for name in self.schema.fieldNames() if name not in have]

    def ensure_schema(self) -> dict:
        """Create the table or add missing columns; never changes existing ones."""
        if not self.exists():
            self.create()
            return {"status": "created", "fields_added": []}
        missing = self.missing_fields()
        if not missing:
            return {"status": "current", "fields_added": []}
        snapshot = self._snapshot()
        stored = StructType.fromJson(snapshot["schema"])
        grown = StructType([*stored.fields, *[self.schema[name] for name in missing]])
        self._publish({**snapshot, "schema": json.loads(grown.json())})
        return {"status": "updated", "fields_added": missing}

    # --- rows -----------------------------------------------------------------------
    def _base(self, snapshot: dict) -> DataFrame:
        schema = StructType.fromJson(snapshot["schema"])
        with_bucket = StructType([*schema.fields, StructField("bucket", IntegerType())])
        paths = [f"{self.root}/rows/commit={commit}/bucket={b}"
                 for b, commit in sorted(snapshot["live"].items(), key=lambda item: int(item[0]))]
        if not paths:
            return self.spark.createDataFrame([], with_bucket)
        rows = self.spark.read.schema(with_bucket).option("basePath", f"{self.root}/rows").parquet(*paths)
        return rows.select(*with_bucket.fieldNames())

    def _changes(self, snapshot: dict) -> DataFrame:
        """Rows of all deltas with ``bucket``, ``_op`` (``put`` or ``kill``) and version ``_v``."""
        schema = StructType.fromJson(snapshot["schema"])
        kinds = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("_op", StringType()),
                            StructField("_v", LongType())])
        rows = self.spark.read.schema(kinds).parquet(*[f"{self.root}/deltas/commit={c}" for c in snapshot["deltas"]])
        return rows.select(*kinds.fieldNames())

    def _resolved(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The last version of each changed chunk, and the killed articles with their version."""
        kills = changes.filter("_op = 'kill'").groupBy("bucket", "article_id").agg(F.max("_v").alias("_killed"))
        puts = changes.filter("_op = 'put'").join(kills, ["bucket", "article_id"], "left")
        puts = puts.filter(F.col("_v") >= F.coalesce("_killed", F.lit(0))).drop("_killed")
        return first_n(puts, ["bucket", "chunk_id"], [F.col("_v").desc()], 1), kills

    def _read(self, snapshot: dict) -> DataFrame:
        base = self._base(snapshot)
        if not snapshot.get("deltas"):
            return base
        puts, kills = self._resolved(self._changes(snapshot))
        base = base.join(kills.select("bucket", "article_id"), ["bucket", "article_id"], "left_anti")
        base = base.join(puts.select("bucket", "chunk_id"), ["bucket", "chunk_id"], "left_anti")
        return base.select(*puts.drop("_op", "_v").columns).unionByName(puts.drop("_op", "_v"))

    def read(self) -> DataFrame:
        """Current rows plus their ``bucket``, which filters and joins can prune on."""
        snapshot = self._snapshot()
        if snapshot is None:
            raise FileNotFoundError(f"no chunk table at {self.root}")
        return self._read(snapshot)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != "bucket"]
        bucket = F.pmod(F.xxhash64("article_id"), F.lit(self._count())).cast("int")
        return rows.select(*names, bucket.alias("bucket"))

    def _count(self) -> int:
        snapshot = self._snapshot()
        return snapshot["buckets"] if snapshot else self.buckets

    def _rebase(self, snapshot: dict, rows: DataFrame) -> None:
        commit = uuid.uuid4().hex
        target = f"{self.root}/rows/commit={commit}"
        # "rebalance" sizes the write tasks at run time: small buckets share
        # one, and a bucket with very many rows is split over several
        rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(target)
        fs, path = self._fs(f"rows/commit={commit}")
        written = {
            status.getPath().getName().split("=")[1]
            for status in fs.listStatus(path) if "=" in status.getPath().getName()
        }
        self._publish({**snapshot, "live": dict.fromkeys(written, commit), "deltas": []})

    def _append(self, snapshot: dict, changes: DataFrame, deltas: list[str], check: bool) -> DataFrame:
        """Write a delta and publish it after ``deltas``; returns its rows."""
        commit = uuid.uuid4().hex
        path = f"{self.root}/deltas/commit={commit}"
        changes.write.parquet(path)
        rows = self.spark.read.schema(changes.schema).parquet(path)
        if check and not rows.filter("_op = 'put'").groupBy("chunk_id").count().filter("count > 1").isEmpty():
            raise ValueError("rows repeat a chunk_id; say by which column the last one is found")
        if not rows.isEmpty():
            self._publish({**snapshot, "deltas": [*deltas, commit]})
        return rows

    def _fold(self) -> None:
        """Many deltas become one; costs the deltas, not the table."""
        snapshot = self._snapshot()
        if len(snapshot.get("deltas", [])) < MAX_DELTAS:
            return
        puts, kills = self._resolved(self._changes(snapshot))
        kills = kills.select("bucket", "article_id", F.lit("kill").alias("_op"), F.col("_killed").alias("_v"))
        self._append(snapshot, puts.unionByName(kills, allowMissingColumns=True).select(*puts.columns), [], False)

    def upsert(self, rows: DataFrame, mode: str = "chunk", order: str | None = None) -> dict:
        """Add rows, the last write of a ``chunk_id`` winning.

        Of rows that repeat a ``chunk_id`` within one call the one with the
        largest ``order`` value stays; without an order they must be unique.
        ``mode="chunk"`` leaves higher-numbered chunks of an article that got
        shorter in place; ``mode="article"`` replaces whole articles.
        """
        if mode not in ("chunk", "article"):
            raise ValueError(f"unknown mode {mode!r}")
        if not self.exists():
            self.create()
        snapshot = self._snapshot()
        stored = StructType.fromJson(snapshot["schema"]).fieldNames()
        kept = [] if order is None else [F.col(order).alias("_order")]
        fresh = self.bucketed(rows.select(*kept, *[
            F.col(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in stored
        ]))
        if order is not None:
            fresh = first_n(fresh, ["bucket", "chunk_id"], [F.col("_order").desc()], 1)
        version = F.lit(snapshot["version"] + 1).cast("long").alias("_v")
        ops = F.array(F.lit("put"), F.lit("kill")) if mode == "article" else F.array(F.lit("put"))
        # an article that is replaced is killed by each of its rows; reading takes the version once
        changes = fresh.select(*stored, "bucket", F.explode(ops).alias("_op"), version)
        written = self._append(snapshot, changes, snapshot.get("deltas", []), order is None)
        counts = written.filter("_op = 'put'").agg(F.count("*"), F.count_distinct("bucket")).first()
        self._fold()
        return {"written": counts[0], "buckets": counts[1]}

    def delete_article(self, article_id: str) -> int:
        """Remove an article's chunks; returns how many there were."""
        snapshot = self._snapshot()
        if snapshot is None:
            return 0
        gone = self._read(snapshot).filter(F.col("article_id") == article_id)
        bucket = F.pmod(F.xxhash64(F.lit(article_id)), F.lit(snapshot["buckets"])).cast("int")
        gone = gone.filter(F.col("bucket") == bucket).count()
        if gone:
            names = StructType.fromJson(snapshot["schema"])
            kill = self.spark.range(1).select(
                *[(F.lit(article_id) if f.name == "article_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in names],
                bucket.alias("bucket"), F.lit("kill").alias("_op"), F.lit(snapshot["version"] + 1).cast("long").alias("_v"))
            self._append(snapshot, kill, snapshot.get("deltas", []), False)
            self._fold()
        return gone

    def compact(self) -> None:
        """Fold all deltas into the base, which rewrites the table."""
        snapshot = self._snapshot()
        if snapshot is None or not snapshot.get("deltas"):
            return
        self._rebase(snapshot, self._read(snapshot))

    def vacuum(self, keep: int = 1) -> int:
        """Delete what only snapshots older than the last ``keep`` name; returns the folders removed.

        Readers and writers of older snapshots must have ended.
        """
        fs, folder = self._fs("snapshots")
        if not fs.exists(folder):
            return 0
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        used: set[str] = set()
        for name in names[-keep:]:
            snapshot = self._load(name)
            used |= set(snapshot["live"].values()) | set(snapshot.get("deltas", []))
        for name in names[:-keep]:
            fs.delete(self._fs(f"snapshots/{name}")[1], False)
        removed = 0
        for kind in ("rows", "deltas"):
            _, path = self._fs(kind)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                if status.getPath().getName().removeprefix("commit=") not in used:
                    removed += bool(fs.delete(status.getPath(), True))
        return removed

    def replace_all(self, rows: DataFrame) -> None:
        """Write a complete new table in one commit."""
        if not self.exists():
            self.create()
        snapshot = self._snapshot()
        names = StructType.fromJson(snapshot["schema"]).fieldNames()
        self._rebase(snapshot, self.bucketed(rows.select(*names)))

    def size(self) -> DataFrame:
        """One row: chunk rows, files and bytes of the current table."""
        snapshot = self._snapshot()
        if snapshot is None:
            raise FileNotFoundError(f"no chunk table at {self.root}")
        folders = [f"rows/commit={c}/bucket={b}" for b, c in snapshot["live"].items()]
        folders += [f"deltas/commit={c}" for c in snapshot.get("deltas", [])]
        files = size = 0
        for name in folders:  # at most one for each bucket and delta
            fs, path = self._fs(name)
            for status in fs.listStatus(path):
                if status.getPath().getName().endswith(".parquet"):
                    files, size = files + 1, size + status.getLen()
        return self._read(snapshot).agg(
            F.count("*").alias("chunks"), F.lit(files).cast("long").alias("files"), F.lit(size).cast("long").alias("bytes"))
