"""Search modes, quality check with retry, and the tool registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from newsloom import constants as C
from newsloom.functions import providers, render
from newsloom.operators import recency
from newsloom.operators.hybrid import Query, hybrid_hits, indexed_hits
from newsloom.operators.lexical import PostingTable, query_terms
from newsloom.operators.ranking import best_per_article
from newsloom.operators.vector import vector_search, with_rows

RESULT_COLUMNS = ["title", "url", "content", "summary", "category", "published_at", "score", "is_exclusive"]
ROW_COLUMNS = [
    "title", "url", "source", "content", "article_summary", "chunk_summary", "category",
    "published_at", "is_exclusive", "chunk_index",
]


@dataclass(frozen=True)
class Intent:
    search_query: str
    mode: str = "hybrid"
    exclusive_only: bool = False
    needs_summary: bool = False
    category: str | None = None
    hours_ago: int | None = None


# Words of the rule-based analyzer that stands in for the language model.
RECENT_WORDS = {"today": 24, "今天": 24, "this week": 168, "本周": 168, "recent": 72, "latest": 72, "最近": 72, "最新": 72}
EXCLUSIVE_WORDS = ["exclusive", "独家"]
SUMMARY_WORDS = ["summarize", "summary", "总结", "概括"]
CONCEPT_WORDS = ["why", "impact", "影响", "为什么"]
CATEGORY_WORDS = ["home", "world", "china", "tech", "finance", "business", "politics", "economy"]


def analyze(query: str) -> Intent:
    """Intent by keyword rules; anything unrecognized is a plain hybrid search."""
    lowered = (query or "").lower()
    if not lowered.strip():
        return Intent(query)
    hours = next((h for word, h in RECENT_WORDS.items() if word in lowered), None)
    concept = any(word in lowered for word in CONCEPT_WORDS)
    words = set(lowered.split())
    return Intent(
        search_query=query,
        mode="recent" if hours else "semantic" if concept else "hybrid",
        exclusive_only=any(w in lowered for w in EXCLUSIVE_WORDS),
        needs_summary=any(w in lowered for w in SUMMARY_WORDS),
        category=next((c for c in CATEGORY_WORDS if c in words), None),
        hours_ago=hours,
    )


def to_results(rows: DataFrame) -> DataFrame:
    """Hits as the eight result columns."""
    score = F.col("score") if "score" in rows.columns else F.lit(None).cast("double").alias("score")
    return rows.select(
        "title", "url", "content",
        render.summary(F.col("article_summary"), F.col("chunk_summary")).alias("summary"),
        "category", "published_at", score, "is_exclusive",
    )


class Engine:
    """Queries over one chunk DataFrame; ``asof`` replaces the wall clock."""

    def __init__(
        self,
        chunks: DataFrame,
        asof: str,
        embedder: providers.Embedder | None = None,
        generate: Callable[[str], str] | None = None,
        index: PostingTable | Callable[[], PostingTable] | None = None,
    ) -> None:
        self.chunks, self.asof, self.generate = chunks, asof, generate
        self.embedder = embedder or providers.WordHistogram()
        self._index = index

    @property
    def index(self) -> PostingTable | None:
        """The posting table; one that was given by a function is made when a search first asks for it."""
        if callable(self._index):
            self._index = self._index()
        return self._index

    def embed(self, text: str) -> list[float]:
        return providers.embed_text(text, self.embedder)

    def _none(self) -> DataFrame:
        rows = self.chunks.filter(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
        return rows.select("article_id", "chunk_id", *ROW_COLUMNS, "score")

    # --- search modes -------------------------------------------------------------
    def semantic(self, text: str, k: int, category: str | None = None, exclusive_only: bool = False) -> DataFrame:
        """The ``k`` articles with the nearest chunks, each with its best chunk."""
        if not text.strip():
            return self._none()
        hits = vector_search(self.chunks, self.embed(text), k, 0.0, category, exclusive_only, per_article=True)
        return with_rows(hits, self.chunks, ROW_COLUMNS)

    def hybrid(self, text: str, k: int, category: str | None = None, exclusive_only: bool = False) -> DataFrame:
        """The ``k`` best articles by hybrid score, each with its best chunk.

        The vector clause covers the ``2k`` nearest chunks.
        """
        if not text.strip():
            return self._none()
        asked = [Query(text, self.embed(text))]
        hits = self._hits(asked, 2 * k, category, exclusive_only, articles=k)
        return with_rows(hits.drop("name"), self.chunks, ROW_COLUMNS)

    def _hits(self, asked: list[Query], k: int, category: str | None = None, exclusive_only: bool = False,
              articles: int | None = None) -> DataFrame:
        """Hybrid hits, from the posting table when there is one."""
        if self.index is not None:
            return indexed_hits(self.chunks, self.index, asked, k, C.TOOL_WEIGHTS, articles, category, exclusive_only)
        return hybrid_hits(self.chunks, asked, k, C.TOOL_WEIGHTS, category, exclusive_only, articles=articles)

    def recent(self, hours: int, k: int, category: str | None = None, exclusive_only: bool = False) -> DataFrame:
        """Newest articles of the window; an empty window falls back to the
        latest articles, which ignore the exclusive filter."""
        rows = recency.recent_news(self.chunks, self.asof, hours, 2 * k, category, exclusive_only)
        if rows.isEmpty():
            rows = recency.latest_articles(self.chunks, k, category)
        rows = rows.orderBy(F.col("published_at").desc_nulls_last(), "article_id").limit(k)
        return rows.withColumn("score", F.lit(None).cast("double"))

    def execute(self, intent: Intent, k: int) -> DataFrame:
        """Run the intent's mode; an unknown mode is hybrid."""
        if intent.mode == "recent":
            hours = intent.hours_ago or C.DEFAULT_RECENT_HOURS
            return self.recent(hours, k, intent.category, intent.exclusive_only)
        search = self.semantic if intent.mode == "semantic" else self.hybrid
        return search(intent.search_query, k, intent.category, intent.exclusive_only)

    # --- evaluate and retry ------------------------------------------------------------
    def evaluate(self, query: str, results: DataFrame) -> int:
        """Quality 1-5: how many query terms the titles mention.

        Stands in for the model's own judgement; no results score 1.
        """
        titles = results.select("title").collect()  # the k rows of a search
        if not titles:
            return 1
        asked = set(query_terms(query))
        if not asked:
            return 3
        seen = set().union(*[query_terms(row["title"] or "") for row in titles])
        return 1 + round(4 * len(asked & seen) / len(asked))

    def news_query(self, query: str, max_results: int = 5, intent: Intent | None = None) -> DataFrame:
        """Analyze, search, evaluate and, for a poor result, try the other mode.

        The retry is kept only when it scores strictly better.
        """
        k = C.clamp("query_results", max_results)
        intent = intent or analyze(query)
        results = self.execute(intent, k)
        score = self.evaluate(query, results)
        if score < 3 and intent.mode != "recent":
            other = replace(intent, mode="semantic" if intent.mode == "hybrid" else "hybrid")
            retried = self.execute(other, k)
            retry_score = self.evaluate(query, retried)
            if retry_score > score:
                results, score, intent = retried, retry_score, other
        return results.withColumn("quality", F.lit(score)).withColumn("mode", F.lit(intent.mode))

    def batch(self, queries: Sequence[tuple[str, str]], k: int, per_query: int) -> DataFrame:
        """Hybrid search of several named texts in one pass, best chunk per article."""
        asked = [Query(text, self.embed(text), name) for name, text in queries]
        hits = self._hits(asked, k, articles=per_query)
        if len(asked) == 1:
            return best_per_article(hits, per_query, rank="rank")
        return best_per_article(hits, per_query, ["name"], rank="rank")

    # --- tools -------------------------------------------------------------------------
    def tool(self, name: str, **arguments) -> DataFrame:
        """Call a tool by the name an agent knows it under."""
        from newsloom.plans import reports

        tools = {
            "news_query": lambda **a: reports.news_query_report(self, **a),
            "trend_analysis": lambda **a: reports.trend_report(self, **a),
            "compare_articles": lambda **a: reports.compare_report(self, **a),
            "deep_research": lambda **a: reports.research_report(self, **a),
            "database_info": lambda **a: reports.database_info(self, **a),
            "daily_briefing": lambda **a: reports.daily_report(self, **a),
        }
        if name not in tools:
            raise KeyError(f"unknown tool {name!r}")
        return tools[name](**arguments)


# a daily briefing is itself the answer; other results go back to the agent
DIRECT_TOOLS = frozenset({"daily_briefing"})
