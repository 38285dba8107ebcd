"""Record shapes: article files, chunk rows, ledgers, sessions, parsed replies."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
BOOL, DOUBLE, NTZ = T.BooleanType(), T.DoubleType(), T.TimestampNTZType()

# one crawled article per JSON file
ARTICLE_FILE = _struct(
    ("title", STRING),
    ("url", STRING),
    ("content", STRING),
    ("author", STRING),
    ("published_at", STRING),
    ("subtitle", STRING),
    ("category", STRING),
    ("source", STRING),
    ("is_exclusive", BOOL),
    ("scraped_at", STRING),
)

# a cleaned article
ARTICLE = _struct(
    ("article_id", STRING),
    ("title", STRING),
    ("url", STRING),
    ("content", STRING),
    ("source", STRING),
    ("category", STRING),
    ("author", STRING),
    ("subtitle", STRING),
    ("is_exclusive", BOOL),
    ("published_at", NTZ),
    ("summary", STRING),
)

# one searchable row per chunk, article columns repeated on each
CHUNK = _struct(
    ("article_id", STRING),
    ("chunk_id", STRING),
    ("chunk_index", INT),
    ("title", STRING),
    ("url", STRING),
    ("source", STRING),
    ("category", STRING),
    ("author", STRING),
    ("subtitle", STRING),
    ("is_exclusive", BOOL),
    ("published_at", NTZ),
    ("crawled_at", NTZ),
    ("content", STRING),
    ("article_summary", STRING),
    ("chunk_summary", STRING),
    ("content_vector", T.ArrayType(T.FloatType())),
)

# what a search returns: no vector, author, subtitle or crawl time
HIT_COLUMNS = [
    "article_id", "chunk_id", "chunk_index", "title", "content", "article_summary",
    "chunk_summary", "url", "source", "category", "published_at", "is_exclusive",
]

INDEXED = _struct(("path", STRING), ("article_id", STRING), ("chunks", LONG), ("indexed_at", NTZ))
FAILED = _struct(("path", STRING), ("error", STRING), ("failed_at", NTZ))

MESSAGE = _struct(
    ("session_id", STRING), ("message_id", STRING), ("seq", LONG), ("role", STRING),
    ("content", STRING), ("ts", NTZ), ("metadata", T.MapType(STRING, STRING)),
)
FEEDBACK = _struct(
    ("session_id", STRING), ("message_id", STRING), ("seq", LONG), ("rating", INT),
    ("comment", STRING), ("ts", NTZ),
)
PROGRESS = _struct(
    ("type", STRING), ("step", STRING), ("content", STRING), ("detail", STRING), ("ts", NTZ),
)

# model replies
INTENT = _struct(
    ("search_query", STRING), ("mode", STRING), ("exclusive_only", BOOL),
    ("needs_summary", BOOL), ("category", STRING), ("hours_ago", INT),
)
EVALUATION = _struct(("score", STRING), ("reason", STRING), ("suggested_mode", STRING))
ANGLES = _struct(("angles", T.ArrayType(_struct(("angle", STRING), ("query", STRING)))))
TOPICS = _struct(
    ("topics", T.ArrayType(_struct(("topic", STRING), ("count", STRING), ("summary", STRING)))),
    ("overall_trend", STRING),
)
