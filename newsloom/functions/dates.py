"""Free-form publication dates, relative dates and their display."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from newsloom import constants as C
from newsloom.functions.text import let, strip

# --- fixed values: accepted layouts, searched anywhere in the lowered text ----
DAY_AND_TIME = r"(?U)(?:updated\s+)?(\w+\.?)\s+(\d{1,2}),?\s+(\d{4})\s+(\d{1,2}):(\d{2})\s*(am|pm)?"
MONTH_FIRST = r"(?U)(\w+\.?)\s+(\d{1,2}),?\s+(\d{4})"
DAY_FIRST = r"(?U)(\d{1,2})\s+(\w+\.?)\s+(\d{4})"
ISO_DATE_TIME = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2})(?::(\d{2})(?::(\d{2}(?:[.,]\d+)?))?)?$"


def _months() -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in C.MONTH_NUMBERS.items())
    return F.create_map(*pairs)


def _groups(text: Column, pattern: str, count: int) -> Column:
    """Array of the first match's groups; null when nothing matches."""
    marked = "\u0001".join(f"${i}" for i in range(1, count + 1))
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", F.split(F.regexp_replace(found, pattern, marked), "\u0001", -1))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _stamp(year, month, day, hour=None, minute=None, second=None) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(
        year, month, day,
        zero if hour is None else hour,
        zero if minute is None else minute,
        F.lit(0).cast("decimal(16,6)") if second is None else second,
    )


def _iso(text: Column) -> Column:
    zoneless = F.regexp_replace(F.replace(text, F.lit("Z"), F.lit("+00:00")), r"[+-]\d{2}:\d{2}$", "")

    def build(g: Column) -> Column:
        optional = lambda i: F.when(g[i] == "", F.lit("0")).otherwise(g[i])
        seconds = F.replace(optional(5), F.lit(","), F.lit(".")).try_cast("decimal(16,6)")
        return _stamp(_number(g[0]), _number(g[1]), _number(g[2]), _number(g[3]), _number(optional(4)), seconds)

    return F.when(text.contains("T"), let(_groups(zoneless, ISO_DATE_TIME, 6), build))


def _written(lowered: Column) -> Column:
    months = _months()
    month = lambda name: F.try_element_at(months, name)

    def with_time(g: Column) -> Column:
        clock, half = _number(g[3]), g[5]
        hour = (
            F.when((half == "pm") & (clock != 12), clock + 12)
            .when((half == "am") & (clock == 12), 0)
            .otherwise(clock)
        )
        return _stamp(_number(g[2]), month(g[0]), _number(g[1]), hour, _number(g[4]))

    return F.coalesce(
        let(_groups(lowered, DAY_AND_TIME, 6), with_time),
        let(_groups(lowered, MONTH_FIRST, 3), lambda g: _stamp(_number(g[2]), month(g[0]), _number(g[1]))),
        let(_groups(lowered, DAY_FIRST, 3), lambda g: _stamp(_number(g[2]), month(g[1]), _number(g[0]))),
    )


def parse_date(col: Column) -> Column:
    """Timestamp without zone, or null when no layout fits.

    A trailing zone is dropped, not converted.  Each layout that matches but
    names no month or no real moment leaves the field to the next one.
    """
    def lower(text: Column) -> Column:
        plain = F.regexp_replace(F.lower(text), r"(?U)\s*(?:" + "|".join(C.ZONE_WORDS) + r")\s*$", "")
        plain = F.regexp_replace(plain, r"(?U)\s+at\s+", " ")
        return strip(F.regexp_replace(plain, r"(?U)\s+", " "))

    return let(strip(col), lambda text: F.coalesce(_iso(text), let(lower(text), _written)))


def iso_text(stamp: Column) -> Column:
    """``2026-01-23T16:39:00``, with microseconds only when there are some."""
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def resolve_day(request: Column, today: Column) -> Column:
    """Day meant by '', today, yesterday or an ISO date; null when none fits."""
    word = F.lower(F.coalesce(request, F.lit("")))
    return (
        F.when(word.isin("", "today", "今天"), today)
        .when(word.isin("yesterday", "昨天"), F.date_sub(today, 1))
        .when(request.rlike(r"^\d{4}-\d{2}-\d{2}$"), request.try_cast("date"))
    )


def display_day(day: Column) -> Column:
    """``2024年1月5日（星期五）``."""
    names = F.array(*[F.lit(name) for name in C.WEEKDAYS])
    return F.concat(
        F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"),
        F.dayofmonth(day).cast("string"), F.lit("日（"),
        F.element_at(names, F.weekday(day) + 1), F.lit("）"),
    )
