"""The service surface as plain calls: each returns a DataFrame or a small dict."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from newsloom import constants as C
from newsloom import schemas as S
from newsloom.functions import render, text as X
from newsloom.operators import enrich, recency, sessions
from newsloom.operators.hybrid import Query, hybrid_search, indexed_hits
from newsloom.operators.vector import vector_search, with_rows
from newsloom.plans.engine import Engine, ROW_COLUMNS
from newsloom.plans.ingest import put_chunks
from newsloom.session import path_exists
from newsloom.sources.articles import request_articles
from newsloom.sources.chunk_table import ChunkTable


class Api:
    """Search, indexing and chat calls over an engine and, optionally, its table."""

    def __init__(self, engine: Engine, table: ChunkTable | None = None, default_source: str = "news") -> None:
        self.engine, self.table, self.default_source = engine, table, default_source
        self.spark = engine.chunks.sparkSession

    def health(self) -> DataFrame:
        """One row per dependency with its state."""
        rows = [("search", "healthy" if self.table is None or self.table.exists() else "missing table")]
        try:
            size = len(self.engine.embed("ok"))
            rows.append(("embedding", f"healthy ({size} dimensions)"))
        except Exception as error:
            rows.append(("embedding", f"unhealthy: {error}"))
        rows.append(("summaries", "generator" if self.engine.generate else "offline"))
        return self.spark.createDataFrame(rows, "service string, state string")

    def setup_index(self) -> dict:
        return self.table.ensure_schema()

    def add_articles(self, payloads: list[dict], crawled_at: str) -> dict:
        """Index articles handed over by a caller; of payloads with one URL the last one stays."""
        rows = request_articles(self.spark, payloads, self.default_source)
        chunks = enrich.process_articles(rows, F.lit(crawled_at), self.engine.embedder, keep=["payload"])
        return put_chunks(self.table, chunks, order="payload", index=self.engine.index)

    def search(self, text: str, k: int = 5, use_hybrid: bool = True) -> DataFrame:
        """Chunk rows, not deduplicated by article; ``k`` is taken as given."""
        columns = [*ROW_COLUMNS, "article_id"]
        vector = self.engine.embed(text)
        if use_hybrid and self.engine.index is not None:
            hits = indexed_hits(self.engine.chunks, self.engine.index, [Query(text, vector)], k, C.API_WEIGHTS)
            rows = with_rows(hits.drop("name"), self.engine.chunks, columns)
            return rows.orderBy(F.col("score").desc(), F.col("chunk_id").asc()).limit(k)
        if use_hybrid:
            return hybrid_search(self.engine.chunks, text, vector, k, C.API_WEIGHTS, columns=columns)
        return vector_search(self.engine.chunks, vector, k, columns=columns)

    def recent(self, hours: int = 24, limit: int = 20, category: str | None = None) -> DataFrame:
        return recency.recent_news(self.engine.chunks, self.engine.asof, hours, limit, category)

    def stats(self) -> DataFrame:
        return recency.database_stats(self.engine.chunks)


# --- chat ------------------------------------------------------------------------------------

SYSTEM_PROMPT = (
    "You answer questions about a news corpus with the tools news_query, trend_analysis, "
    "compare_articles, deep_research, database_info and daily_briefing.\n"
    "Today is {day} ({weekday}), {time}.\n"
)
HISTORY_HEADING = "\n## Conversation so far\n{history}\n"
FEEDBACK_HEADING = "\n## User feedback\n{feedback}\nAdjust your answers accordingly.\n"


class ChatLog:
    """Messages and feedback of chat sessions, appended to shared tables."""

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def messages(self) -> DataFrame:
        return self._read("messages", S.MESSAGE)

    def feedback(self) -> DataFrame:
        return self._read("feedback", S.FEEDBACK)

    def deleted(self) -> DataFrame:
        return self._read("deleted", "session_id string")

    def _append(self, name: str, rows: list[tuple], schema) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def create_session(self) -> str:
        return uuid.uuid4().hex[:16]

    def add_message(self, session_id: str, role: str, content: str, at: datetime, metadata: dict | None = None) -> str:
        """Store a message and return its id; blank content is an error."""
        if not content or not content.strip():
            raise ValueError("message cannot be blank")
        message_id = uuid.uuid4().hex[:12]
        seq = int(at.timestamp() * 1_000_000)
        self._append("messages", [(session_id, message_id, seq, role, content, at, metadata or {})], S.MESSAGE)
        return message_id

    def add_feedback(self, session_id: str, message_id: str, rating: int, comment: str | None, at: datetime) -> None:
        """Store feedback; the message it names is not looked up."""
        if not 1 <= rating <= 5:
            raise ValueError("rating must be 1 to 5")
        seq = int(at.timestamp() * 1_000_000)
        self._append("feedback", [(session_id, message_id, seq, rating, comment, at)], S.FEEDBACK)

    def delete_session(self, session_id: str) -> bool:
        known = not self.messages().filter(F.col("session_id") == session_id).isEmpty()
        if known:
            self._append("deleted", [(session_id,)], "session_id string")
        return known

    def is_live(self, session_id: str, asof: str) -> bool:
        mine = self.messages().filter(F.col("session_id") == session_id)
        mine = mine.join(self.deleted(), "session_id", "left_anti")
        row = sessions.last_activity(mine).filter(~sessions.is_expired(F.col("last_active"), asof)).first()
        return row is not None

    def system_prompt(self, session_id: str, asof: str) -> str:
        """Instructions plus recent history and feedback of the session."""
        mine = self.messages().filter(F.col("session_id") == session_id)
        history = sessions.prompt_history(mine).first()
        notes = sessions.feedback_summary(self.feedback().filter(F.col("session_id") == session_id), asof).first()
        now = datetime.fromisoformat(asof)
        prompt = SYSTEM_PROMPT.format(day=asof[:10], weekday=C.WEEKDAYS[now.weekday()], time=now.strftime("%H:%M"))
        if history:
            prompt += HISTORY_HEADING.format(history=history["history"])
        if notes:
            prompt += FEEDBACK_HEADING.format(feedback=notes["summary"])
        return prompt


def chat(engine: Engine, log: ChatLog, message: str, at: datetime, session_id: str | None = None) -> dict:
    """Answer one message with the news query tool and remember both sides."""
    if session_id is None or not log.is_live(session_id, str(at)):
        session_id = log.create_session()
    log.add_message(session_id, "user", message, at)
    answer = engine.tool("news_query", query=message).first()["report"]
    message_id = log.add_message(session_id, "assistant", answer, at)
    return {"session_id": session_id, "message_id": message_id, "response": answer}


def stream_frames(spark, answer: str) -> Iterator[str]:
    """Server-sent-event frames of one answer, in order."""
    row = spark.createDataFrame([(answer,)], "answer string")
    pieces = row.select(F.posexplode(X.stream_slices(F.col("answer"))).alias("pos", "content"))
    frame = render.event_frame(F.lit("delta").alias("type"), F.col("content"))
    for item in pieces.select("pos", frame.alias("frame")).orderBy("pos").toLocalIterator():
        yield item["frame"]
