"""Text layouts: search results, chat history, feedback and event frames."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom import constants as C
from newsloom.functions.text import first_filled, preview


def _or(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def category_name(category: Column) -> Column:
    """Display name of a category; an unknown one shows as itself."""
    pairs = [F.lit(part) for pair in C.CATEGORY_DISPLAY.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), category)


def summary(article_summary: Column, chunk_summary: Column) -> Column:
    return first_filled(article_summary, chunk_summary)


def result_text(row) -> Column:
    """Seven-line block of one search result; ``row(name)`` gives its columns."""
    shown_score = F.coalesce(F.format_string("%.4f", row("score")), F.lit("N/A"))
    shown_score = F.when(row("score").isNull(), F.lit("N/A")).otherwise(shown_score)
    mark = F.when(F.coalesce(row("is_exclusive"), F.lit(False)), F.lit(" [EXCLUSIVE]")).otherwise(F.lit(""))
    return F.concat(
        F.lit("Title: "), _or(row("title"), "N/A"), mark,
        F.lit("\nCategory: "), _or(row("category"), "N/A"),
        F.lit("\nPublished: "), _or(row("published_at"), "N/A"),
        F.lit("\nSummary: "), _or(row("summary"), "N/A"),
        F.lit("\nContent: "), _or(preview(row("content"), C.RESULT_PREVIEW_CHARS), "N/A"),
        F.lit("\nURL: "), _or(row("url"), "N/A"),
        F.lit("\nRelevance Score: "), shown_score,
    )


def role_label(role: Column) -> Column:
    return F.when(role == "user", F.lit("用户")).otherwise(F.lit("助手"))


def history_line(role: Column, content: Column) -> Column:
    return F.concat(role_label(role), F.lit(": "), preview(content, C.HISTORY_PREVIEW_CHARS))


def feedback_line(rating: Column, comment: Column) -> Column:
    note = F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit(" — "), comment)).otherwise(F.lit(""))
    return F.concat(F.lit("- Rating: "), rating.cast("string"), F.lit("/5"), note)


def event_frame(*cols: Column) -> Column:
    """Server-sent-event frame of a struct, non-ASCII characters kept."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*cols)), F.lit("\n\n"))
