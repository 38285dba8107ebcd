"""What the operators share: reading, written intermediates, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.session import scratch_path

#: Rows of text in one Arrow batch; long texts are bounded by Spark's byte limit for a batch.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS, size: str = TEXT_BATCH_BYTES) -> None:
    """Bound the Arrow batches that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    Cuts the lineage: a lost executor costs a re-read, and a table that is used
    several times is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered_columns(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns other than ``doc_id`` and ``text`` named ``c0, c1, ...``, and what names them back.

    Working columns of an operator can then clash with none of the caller's.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    inner = [c if c.lower() in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    return (docs.select(*[col.alias(name) for col, name in zip(quoted, inner)]),
            [F.col(name).alias(c) for name, c in zip(inner, docs.columns)])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def give_back() -> None:
    """Return freed memory to the machine: a worker goes on to tasks of other kinds, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, work: Callable[[Batches], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dictionaries of column values."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Batches) -> Batches:
        for columns in work(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, field.type)
                      for c, field in zip((columns[f.name] for f in arrow), arrow)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)
        give_back()

    return df.mapInArrow(run, kind)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Texts of a batch as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class BatchWords:
    """White-space separated words of a batch of texts, null as empty.

    ``different`` holds each word once; ``code`` has its place in there for every
    word in order, and ``row`` the text it stands in.
    """

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(texts.fill_null(""))
        found = split.flatten().dictionary_encode()
        self.different = found.dictionary
        code, offsets = found.indices.to_numpy(), split.offsets.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        empty = pc.index(self.different, "").as_py()  # stands for space at the ends of a text
        kept = code != empty if empty >= 0 else slice(None)
        self.code, self.row, self.rows = code[kept], row[kept], len(texts)

    def sizes(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.row, minlength=self.rows)


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
