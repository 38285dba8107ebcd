"""Chat history, feedback and session expiry in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import constants as C
from newsloom.functions import render
from newsloom.operators.ranking import first_n


def recent_messages(messages: DataFrame, limit: int = C.SESSION_MESSAGE_LIMIT) -> DataFrame:
    """The last ``limit`` messages of each session."""
    return first_n(messages, ["session_id"], [F.col("seq").desc()], limit)


def prompt_history(messages: DataFrame, limit: int = C.PROMPT_MESSAGE_LIMIT) -> DataFrame:
    """``(session_id, history)``: labelled, shortened lines, oldest first.

    At most ``limit`` messages of a session reach the collect.
    """
    recent = recent_messages(messages, limit)
    line = F.struct("seq", render.history_line(F.col("role"), F.col("content")).alias("line"))
    ordered = F.sort_array(F.collect_list(line))
    return recent.groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda m: m["line"]), "\n").alias("history")
    )


def recent_feedback(feedback: DataFrame, asof: str, limit: int = C.FEEDBACK_LIMIT) -> DataFrame:
    """Last ``limit`` feedback entries per session of the past 30 minutes."""
    start = F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(C.SESSION_TTL_MINUTES))
    return first_n(feedback.filter(F.col("ts") >= start), ["session_id"], [F.col("seq").desc()], limit)


def feedback_summary(feedback: DataFrame, asof: str) -> DataFrame:
    """``(session_id, summary)``; sessions without recent feedback have no row."""
    line = F.struct("seq", render.feedback_line(F.col("rating"), F.col("comment")).alias("line"))
    ordered = F.sort_array(F.collect_list(line))
    return recent_feedback(feedback, asof).groupBy("session_id").agg(
        F.concat(F.lit("Recent feedback:\n"), F.array_join(F.transform(ordered, lambda m: m["line"]), "\n"))
        .alias("summary")
    )


def feedback_messages(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Feedback with the message it is about; an unknown message stays null."""
    about = messages.select("message_id", F.col("role").alias("about_role"), F.col("content").alias("about"))
    return feedback.join(about, "message_id", "left")


def last_activity(messages: DataFrame) -> DataFrame:
    """Only messages keep a session alive; reads do not."""
    return messages.groupBy("session_id").agg(F.max("ts").alias("last_active"))


def is_expired(last_active: Column, asof: str, minutes: int = C.SESSION_TTL_MINUTES) -> Column:
    """Idle for strictly more than the limit."""
    return last_active + F.make_dt_interval(mins=F.lit(minutes)) < F.lit(asof).cast("timestamp_ntz")


def session_counts(messages: DataFrame, asof: str) -> DataFrame:
    """One row: active and expired sessions."""
    idle = is_expired(F.col("last_active"), asof)
    return last_activity(messages).agg(
        F.count_if(~idle).alias("active_sessions"), F.count_if(idle).alias("expired_sessions")
    )


def activity_sessions(events: DataFrame, key: str, minutes: int = C.SESSION_TTL_MINUTES) -> DataFrame:
    """Runs of activity with gaps of at most ``minutes``.

    ``session_window`` merges sessions inside each map task first (see
    ``session.RUNTIME_CONF``), so a very busy key ships sessions, not events.
    The window end is the last event plus the gap; here the last event is kept.
    """
    window = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy(key, window.alias("w")).agg(
        F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last_event")
    ).drop("w")


SEQ_BLOCK = 4096


def visible_deltas(events: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """Text pieces of an agent run that reach the reader.

    Per run, in ``seq`` order with kinds ``delta``, ``tool_call``,
    ``tool_result`` (``direct`` marks a result that is itself the answer) and
    ``output``: pieces before the first tool call are shown only if no tool is
    ever called and the run ends; pieces after a result are shown until the
    next call, unless a direct answer was returned.

    The running values are built in two levels, inside blocks of ``seq`` and
    over one summary row per block, so a very long run is not one window.
    """
    is_call, is_result = F.col("kind") == "tool_call", F.col("kind") == "tool_result"
    marks = {
        "call": F.when(is_call, F.col("seq")),
        "result": F.when(is_result, F.col("seq")),
        "direct_at": F.when(is_result & F.col("direct"), F.col("seq")),
    }
    rows = events.withColumn("block", F.floor(F.col("seq") / block))
    summary = rows.groupBy("run_id", "block").agg(
        *[F.max(mark).alias(f"own_{name}") for name, mark in marks.items()],
        F.max(F.col("kind") == "output").alias("own_finished"),
    )
    earlier = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    carried = summary.select(
        "run_id", "block",
        *[F.max(f"own_{name}").over(earlier).alias(f"prior_{name}") for name in marks],
        F.max("own_call").over(whole).isNotNull().alias("any_call"),
        F.max("own_finished").over(whole).alias("finished"),
    )
    inside = Window.partitionBy("run_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.max(mark).over(inside).alias(f"local_{name}") for name, mark in marks.items()])
    placed = local.join(carried, ["run_id", "block"])
    call, result, direct = (F.greatest(f"local_{n}", f"prior_{n}") for n in marks)
    shown = F.when(call.isNull(), ~F.col("any_call") & F.col("finished")).otherwise(
        (F.coalesce(result, F.lit(-1)) > call) & direct.isNull()
    )
    return placed.filter((F.col("kind") == "delta") & shown).select("run_id", "seq", "content")


def merged_events(progress: DataFrame, deltas: DataFrame) -> DataFrame:
    """Two producers' events as one stream of rows, to be read in ``ts`` order."""
    return progress.unionByName(deltas, allowMissingColumns=True)


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    """Events a reader has not seen yet."""
    return events.filter(F.col("seq") > cursor)
