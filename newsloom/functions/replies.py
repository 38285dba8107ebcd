"""Parsing of model replies and user-supplied argument strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom import schemas as S
from newsloom.functions.text import strip


def unfence(reply: Column) -> Column:
    """Body of a ``` block: after its first line, before its last fence."""
    text = strip(reply)
    body = F.regexp_replace(text, r"(?s)^```[^\n]*\n", "")
    return F.when(text.startswith("```"), F.regexp_replace(body, r"(?s)```(?:(?!```).)*$", "")).otherwise(text)


def _json(text: Column, schema) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def parse_intent(reply: Column, query: Column) -> Column:
    """Intent struct; a reply that is no JSON object means plain hybrid search."""
    text = unfence(reply)
    parsed = _json(text, S.INTENT)
    readable = F.get_json_object(text, "$").isNotNull() & text.startswith("{")
    pick = lambda name, default: F.when(readable, F.coalesce(parsed[name], default)).otherwise(default)
    return F.struct(
        F.when(readable, F.coalesce(parsed["search_query"], F.lit(""))).otherwise(query).alias("search_query"),
        pick("mode", F.lit("hybrid")).alias("mode"),
        pick("exclusive_only", F.lit(False)).alias("exclusive_only"),
        pick("needs_summary", F.lit(False)).alias("needs_summary"),
        F.when(readable, parsed["category"]).alias("category"),
        F.when(readable, parsed["hours_ago"]).alias("hours_ago"),
    )


# --- fixed values: reason given when an evaluation cannot be read --------------
UNREADABLE_EVALUATION = "评估解析失败"


def parse_evaluation(reply: Column) -> Column:
    """Score 1-5 (3 when absent or unreadable), reason and suggested mode."""
    text = unfence(reply)
    inner = F.regexp_extract(text, r"(?s)\{[^}]+\}", 0)
    text = F.when(inner != "", inner).otherwise(text)
    parsed = _json(text, S.EVALUATION)
    score = F.coalesce(parsed["score"], F.lit("3")).try_cast("double").cast("int")
    readable = F.get_json_object(text, "$").isNotNull() & score.isNotNull()
    return F.struct(
        F.when(readable, F.greatest(F.lit(1), F.least(F.lit(5), score))).otherwise(3).alias("score"),
        F.when(readable, F.coalesce(parsed["reason"], F.lit("")))
        .otherwise(UNREADABLE_EVALUATION).alias("reason"),
        F.when(readable, parsed["suggested_mode"]).alias("suggested_mode"),
    )


# --- fixed values: angles used when none can be read ---------------------------
DEFAULT_ANGLES = [
    ("核心动态", ""),
    ("市场影响", "market impact economic implications"),
    ("政策与监管", "policy regulation government response"),
    ("行业趋势", "industry trend outlook future development"),
]


def parse_angles(reply: Column, topic: Column, limit: int = 4) -> Column:
    """Angles that carry both a name and a query, else the default ones."""
    listed = _json(unfence(reply), S.ANGLES)["angles"]
    usable = F.slice(
        F.filter(listed, lambda a: a["angle"].isNotNull() & a["query"].isNotNull()), 1, limit
    )
    fallback = F.array(*[
        F.struct(F.lit(name).alias("angle"),
                 strip(F.concat(topic, F.lit(f" {suffix}"))).alias("query"))
        for name, suffix in DEFAULT_ANGLES
    ])
    return F.when(F.coalesce(F.size(usable), F.lit(0)) > 0, usable).otherwise(fallback)


def parse_topics(reply: Column) -> Column:
    """Struct of trend topics and the overall trend; null fields when unreadable."""
    return _json(unfence(reply), S.TOPICS)


def topic_list(text: Column) -> Column:
    """Comma-separated topics, stripped, blanks dropped, first spelling kept once."""
    parts = F.transform(F.split(text, ","), strip)
    return F.filter(parts, lambda t: t != "")


def topic_list_error(text: Column) -> Column:
    count = F.size(topic_list(text))
    return (
        F.when(count < 2, "at least 2 topics")
        .when(count > 4, "at most 4 topics")
    )
