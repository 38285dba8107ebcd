"""Queries of chat history, feedback, sessions and event frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.functions import render
from newsloom.operators import filters, sessions
from newsloom.sources import fixtures as X

ASOF = "2024-01-30 12:00:00"

_MESSAGES = """
messages AS (SELECT conv_id::VARCHAR AS session_id, conv_id || '-' || turn AS message_id, turn AS seq, role, "text" AS content FROM conversations)"""
_FEEDBACK = """
feedback AS (SELECT user_id::VARCHAR AS session_id, user_id || '-0' AS message_id, event_id AS seq,
  ((props->>'$.k')::INT % 5 + 1)::INT AS rating, CASE WHEN event_type <> 'error' THEN event_type END AS comment, ts FROM events)"""
_RECENT_FEEDBACK = _FEEDBACK + f""",
recent AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM feedback WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 30 MINUTE)"""


@query("chat_history_tail", f"""
WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM messages)
SELECT session_id, seq, role, content FROM r WHERE rn <= 3""")
def chat_history_tail(spark, sf):
    return sessions.recent_messages(X.messages(spark, sf), 3).select("session_id", "seq", "role", "content")


@query("chat_prompt_history", f"""
WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn FROM messages)
SELECT session_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' ||
  CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END, chr(10) ORDER BY seq) AS history
FROM r WHERE rn <= 20 GROUP BY session_id""")
def chat_prompt_history(spark, sf):
    return sessions.prompt_history(X.messages(spark, sf))


@query("feedback_recent", f"WITH {_RECENT_FEEDBACK} SELECT session_id, seq, rating, comment FROM recent WHERE rn <= 3")
def feedback_recent(spark, sf):
    return sessions.recent_feedback(X.feedback(spark, sf), ASOF).select("session_id", "seq", "rating", "comment")


@query("feedback_summary", f"""
WITH {_RECENT_FEEDBACK} SELECT session_id, 'Recent feedback:' || chr(10) || string_agg('- Rating: ' || rating || '/5' ||
  CASE WHEN comment IS NOT NULL THEN ' — ' || comment ELSE '' END, chr(10) ORDER BY seq) AS summary
FROM recent WHERE rn <= 3 GROUP BY session_id""")
def feedback_summary(spark, sf):
    return sessions.feedback_summary(X.feedback(spark, sf), ASOF)


@query("feedback_messages", f"""
WITH {_MESSAGES}, {_FEEDBACK}
SELECT f.seq, f.message_id, m.role AS about_role FROM feedback f LEFT JOIN messages m USING (message_id)""")
def feedback_messages(spark, sf):
    rows = sessions.feedback_messages(X.feedback(spark, sf), X.messages(spark, sf))
    return rows.select("seq", "message_id", "about_role")


@query("rating_domain", """
SELECT event_id, coalesce((props->>'$.k')::INT BETWEEN 1 AND 5, false) AS accepted FROM events""")
def rating_domain(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return X.table(spark, sf, "events").select("event_id", filters.valid_rating(k).alias("accepted"))


_ACTIVITY = "a AS (SELECT user_id::VARCHAR AS session_id, max(ts) AS last_active FROM events GROUP BY user_id)"


def _activity(spark, sf):
    return X.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts")


@query("session_expiry", f"""
WITH {_ACTIVITY} SELECT session_id, last_active, TIMESTAMP '2024-01-30 23:00:00' - last_active > INTERVAL 30 MINUTE AS expired FROM a""")
def session_expiry(spark, sf):
    rows = sessions.last_activity(_activity(spark, sf))
    return rows.withColumn("expired", sessions.is_expired(F.col("last_active"), "2024-01-30 23:00:00"))


@query("session_counts", f"""
WITH {_ACTIVITY}, e AS (SELECT TIMESTAMP '2024-01-30 23:00:00' - last_active > INTERVAL 30 MINUTE AS expired FROM a)
SELECT count(*) FILTER (NOT expired) AS active_sessions, count(*) FILTER (expired) AS expired_sessions FROM e""")
def session_counts(spark, sf):
    return sessions.session_counts(_activity(spark, sf), "2024-01-30 23:00:00")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS events, min(ts) AS started, max(ts) AS last_event FROM s GROUP BY user_id, n""")
def session_windows(spark, sf):
    return sessions.activity_sessions(X.table(spark, sf, "events"), "user_id")


# conversations as agent runs: system turns call tools, user turns return them
_RUNS = """
runs AS (SELECT conv_id AS run_id, turn AS seq, CASE role WHEN 'system' THEN 'tool_call' WHEN 'user' THEN 'delta' ELSE CASE WHEN length("text") > 600 THEN 'tool_result' ELSE 'delta' END END AS kind,
  length("text") > 3000 AS direct, md5("text") AS content FROM conversations
  UNION ALL SELECT conv_id, max(turn) + 1, 'output', false, '' FROM conversations GROUP BY conv_id)"""


@query("visible_deltas", f"""
WITH {_RUNS}, m AS (SELECT *, max(CASE WHEN kind = 'tool_call' THEN seq END) OVER w AS call, max(CASE WHEN kind = 'tool_result' THEN seq END) OVER w AS result,
  bool_or(kind = 'tool_result' AND direct) OVER w AS direct_before, bool_or(kind = 'tool_call') OVER (PARTITION BY run_id) AS any_call
  FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT run_id, seq, content FROM m WHERE kind = 'delta' AND CASE WHEN call IS NULL THEN NOT any_call ELSE coalesce(result, -1) > call AND NOT direct_before END""")
def visible_deltas(spark, sf):
    turns = X.table(spark, sf, "conversations")
    long_answer = F.when(F.length("text") > 600, "tool_result").otherwise("delta")
    kind = F.when(F.col("role") == "system", "tool_call").when(F.col("role") == "user", "delta").otherwise(long_answer)
    rows = turns.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), kind.alias("kind"),
        (F.length("text") > 3000).alias("direct"), F.md5("text").alias("content"),
    )
    ends = turns.groupBy(F.col("conv_id").alias("run_id")).agg((F.max("turn") + 1).alias("seq")).select(
        "run_id", "seq", F.lit("output").alias("kind"), F.lit(False).alias("direct"), F.lit("").alias("content")
    )
    return sessions.visible_deltas(rows.unionByName(ends), block=2)


@query("event_frames", """
SELECT event_id, 'data: {"type":"step","step":"' || event_type || '","content":"用户 ' || user_id || '"}' || chr(10) || chr(10) AS frame FROM events""")
def event_frames(spark, sf):
    return X.table(spark, sf, "events").select("event_id", render.event_frame(
        F.lit("step").alias("type"), F.col("event_type").alias("step"),
        F.concat(F.lit("用户 "), F.col("user_id").cast("string")).alias("content"),
    ).alias("frame"))


@query("event_merge", """
SELECT ts, 'step' AS type, event_type AS content FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT ts, 'delta', props FROM events WHERE event_type NOT IN ('click', 'view')""")
def event_merge(spark, sf):
    events = X.table(spark, sf, "events")
    steps = F.col("event_type").isin("click", "view")
    return sessions.merged_events(
        events.filter(steps).select("ts", F.lit("step").alias("type"), F.col("event_type").alias("content")),
        events.filter(~steps).select("ts", F.lit("delta").alias("type"), F.col("props").alias("content")),
    )


@query("events_after_cursor", """
SELECT conv_id, turn, role FROM conversations WHERE turn > 3""")
def events_after_cursor(spark, sf):
    rows = X.table(spark, sf, "conversations").withColumn("seq", F.col("turn"))
    return sessions.events_after(rows, 3).select("conv_id", "turn", "role")
