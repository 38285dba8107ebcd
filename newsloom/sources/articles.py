"""Article files and cleaned article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newsloom import schemas as S
from newsloom.functions import dates, text as X, urls
from newsloom.operators.filters import article_error

_CORRUPT = "_corrupt"


def read_article_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """One row per JSON file with its ``path``; unreadable JSON sets ``read_error``."""
    schema = StructType([*S.ARTICLE_FILE.fields, StructField(_CORRUPT, StringType())])
    reader = (
        spark.read.schema(schema)
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", str(recursive).lower())
    )
    rows = reader.json(directory)
    path = urls.unix_path(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/"))
    return rows.select(
        path.alias("path"),
        *S.ARTICLE_FILE.fieldNames(),
        F.when(F.col(_CORRUPT).isNotNull(), F.lit("Invalid JSON")).alias("read_error"),
    )


def check_records(files: DataFrame) -> DataFrame:
    """The records with stripped fields and ``problem``, null for usable ones."""
    fields = ["title", "content", "url"]
    others = [c for c in files.columns if c not in fields]
    rows = X.computed_once(files, others, **{f: X.strip(F.col(f)) for f in fields})
    problem = article_error(*[F.col(f) for f in fields])
    if "read_error" in others:
        problem = F.coalesce(F.col("read_error"), problem)
    return rows.withColumn("problem", problem)


def validate(files: DataFrame) -> DataFrame:
    """``(path, is_valid, error)`` without building article rows."""
    return check_records(files).select(
        "path", F.col("problem").isNull().alias("is_valid"), F.col("problem").alias("error")
    )


def to_articles(checked: DataFrame, default_source: str, keep: list[str] = []) -> DataFrame:
    """Usable records as articles: parsed date, id from the normalized URL.

    The URL itself is stored as it came.
    """
    return checked.filter("problem IS NULL").select(
        *keep,
        urls.article_id(F.col("url")).alias("article_id"),
        "title", "url", "content",
        F.coalesce(F.col("source"), F.lit(default_source)).alias("source"),
        F.col("category"),
        X.squeeze(F.col("author")).alias("author"),
        F.col("subtitle"),
        F.coalesce(F.col("is_exclusive"), F.lit(False)).alias("is_exclusive"),
        dates.parse_date(F.col("published_at")).alias("published_at"),
        F.lit(None).cast("string").alias("summary"),
    )


def clean(files: DataFrame, default_source: str, keep: list[str] = []) -> DataFrame:
    """Check and convert article records in one step."""
    return to_articles(check_records(files), default_source, keep)


def request_articles(spark: SparkSession, payloads: list[dict], default_source: str) -> DataFrame:
    """Articles handed over as request payloads instead of files, with their position."""
    rows = [(i, *[p.get(f) for f in S.ARTICLE_FILE.fieldNames()]) for i, p in enumerate(payloads)]
    schema = StructType([StructField("payload", LongType()), *S.ARTICLE_FILE.fields])
    return clean(spark.createDataFrame(rows, schema), default_source, keep=["payload"])


def request_rows(bodies: DataFrame, default_source: str) -> DataFrame:
    """Articles of request bodies, a table ``payload, body`` with JSON text; unusable ones are left out."""
    record = F.from_json("body", S.ARTICLE_FILE)
    rows = bodies.select("payload", record.alias("_r")).select("payload", *[F.col(f"_r.{f}") for f in S.ARTICLE_FILE.fieldNames()])
    return clean(rows, default_source, keep=["payload"])
