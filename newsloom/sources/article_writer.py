"""Article files by path: a data source that writes each row to the file it names."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from newsloom.session import path_exists

FORMAT = "article_files"


@dataclass
class Written(WriterCommitMessage):
    files: int


class ArticleFileWriter(DataSourceWriter):
    """Each row becomes the JSON file ``root/path``.

    A file is written beside its place and moved there in one step, so a reader
    never meets half a file and a task that runs again after a lost executor
    puts the same file in the same place.  A run that ends well leaves ``_SUCCESS``.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator[Row]) -> Written:
        done = 0
        for row in rows:
            record = row.asDict(recursive=True)
            target = os.path.normpath(os.path.join(self.root, record.pop("path")))
            if not target.startswith(self.root + os.sep):
                raise ValueError(f"path outside of the folder: {target}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            beside = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}.part"
            with open(beside, "w", encoding="utf-8") as out:
                json.dump({k: v for k, v in record.items() if v is not None}, out, ensure_ascii=False, default=str)
            os.replace(beside, target)
            done += 1
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.root, exist_ok=True)
        with open(f"{self.root}/_SUCCESS", "w", encoding="utf-8") as out:
            out.write(str(sum(m.files for m in messages if m is not None)))


class ArticleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ArticleFileWriter:
        if overwrite:
            raise ValueError("article files are added, never overwritten as a whole")
        return ArticleFileWriter(local_root(self.options["path"]))


def local_root(path: str) -> str:
    """Path of a mounted folder, which every executor has to reach under the same name."""
    bare = path.removeprefix("file:")
    if "://" in bare.removeprefix("//"):
        raise ValueError(f"not a mounted folder: {path}")
    return os.path.normpath("/" + bare.lstrip("/"))


def write_article_files(articles: DataFrame, root: str) -> None:
    """Write ``articles``, which have their file's ``path`` below ``root``, one JSON file each."""
    articles.sparkSession.dataSource.register(ArticleFiles)
    articles.write.format(FORMAT).mode("append").save(local_root(root))


def stored_paths(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every JSON file below ``root``, relative to it; the files are listed, not read."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], "path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return found.select(F.substring_index("path", f"{local_root(root)}/", -1).alias("path"))
