"""Whitespace, sentences, windows, sizes and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import constants as C

# white space as Python counts it: Unicode spaces plus the ASCII separators
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# white space that is not already one single blank
_LOOSE = SPACE.replace("\\x20", "\\x1f") + SPACE + "*| " + SPACE + "+"
# squeezed text has single blanks only
SENTENCE_BREAK = "(?<=[.!?。！？]) "
SENTENCE_END = "[.!?。！？](?=" + SPACE + ")"
WORD = r"[\p{L}\p{N}]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Catalyst inlines a projected expression wherever it is used; a lambda
    variable is bound to the computed value instead.
    """
    return F.get(F.transform(F.array(value), use), 0)


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` plus new columns that later steps may use any number of times.

    The one-row ``inline`` keeps the optimizer from merging this projection
    into the next one and repeating its regular expressions there.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline(made))


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.trim(col, F.lit(SPACE_CHARS))


def squeeze(col: Column) -> Column:
    """Strip, then turn each run of white space into one blank."""
    return F.trim(F.regexp_replace(col, _LOOSE, " "))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def clean_author(col: Column) -> Column:
    """Collapse white space and drop a leading "By "."""
    return squeeze(F.regexp_replace(col, r"(?iU)^\s*By\s+", ""))


def sentences(col: Column) -> Column:
    """Sentences of a text; text without a break after its marks is one sentence."""
    return F.filter(F.split(squeeze(col), SENTENCE_BREAK, -1), lambda s: s != "")


def windows(col: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` later."""
    step = size - overlap
    if step == 0:
        raise ValueError("overlap must differ from size")
    if step < 0:
        return F.array().cast("array<string>")
    starts = F.sequence(F.lit(0), F.greatest(F.length(col) - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda i: F.substring(col, i + 1, F.lit(size)))
    return F.when(F.length(col) > 0, cut).otherwise(F.array().cast("array<string>"))


def token_estimate(col: Column) -> Column:
    return F.coalesce(F.floor(F.length(col) / C.CHARS_PER_TOKEN), F.lit(0)).cast("int")


def truncate_tokens(col: Column, max_tokens: int) -> Column:
    limit = max_tokens * C.CHARS_PER_TOKEN
    short = F.concat(F.substring(col, 1, limit - 3), F.lit("..."))
    return F.when(F.length(col) > limit, short).otherwise(col)


def preview(col: Column, limit: int, ellipsis: bool = True) -> Column:
    """First ``limit`` characters; the dots only mark text that was cut."""
    cut = F.substring(col, 1, limit)
    if ellipsis:
        cut = F.concat(cut, F.lit("..."))
    return F.when(F.length(col) > limit, cut).otherwise(col)


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor empty; empty string when none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def lead(col: Column, count: int) -> Column:
    """The first ``count`` sentences, joined by blanks (the offline summary).

    Reads no further than the end of the last one; a text with fewer is whole.
    """
    start = f"(?s)^(?:.*?{SENTENCE_END}){{{count}}}"
    return let(strip(col), lambda text: squeeze(
        F.coalesce(F.nullif(F.regexp_extract(text, start, 0), F.lit("")), text)
    ))


def tokens(column: str) -> Column:
    """Lower-cased words of a column without stop words; null text has none."""
    stop = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
    words = f"regexp_extract_all(lower(coalesce({column}, '')), r'{WORD}', 0)"
    return F.expr(f"filter({words}, w -> w NOT IN ({stop}))")


def stream_slices(col: Column, size: int = C.STREAM_SLICE_CHARS) -> Column:
    """Each line plus its newline, cut into pieces of at most ``size`` characters."""
    lines = F.transform(F.split(col, "\n", -1), lambda line: F.concat(line, F.lit("\n")))
    return F.flatten(F.transform(lines, lambda line: F.transform(
        F.sequence(F.lit(0), F.length(line) - 1, F.lit(size)),
        lambda i: F.substring(line, i + 1, F.lit(size)),
    )))
