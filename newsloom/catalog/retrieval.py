"""Queries of the chunk repository and the search modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import constants as C
from newsloom.catalog import query, sql as Q
from newsloom.functions.providers import embed_text, embedding
from newsloom.operators import recency
from newsloom.operators.cells import VectorCells
from newsloom.operators.hybrid import Query, hybrid_batch, hybrid_search, indexed_hits
from newsloom.operators.lexical import PostingTable, keyword_search, postings
from newsloom.operators.ranking import best_per_article
from newsloom.operators.statistics import BatchStats
from newsloom.operators.vector import vector_search
from newsloom.plans.engine import Engine, Intent
from newsloom.session import scratch_path
from newsloom.sources import fixtures as X

TEXT = "thin the therin onesen"
OTHER_TEXT = "eauou mentelle eauenaux"
VECTOR = embed_text(TEXT)
HOURS = 72
DAY = "2024-01-15"

_SINCE = f"published_at >= TIMESTAMP '{X.ASOF}' - INTERVAL {HOURS} HOUR"
_EVENT_COLUMNS = ["article_id", "chunk_id", "category", "is_exclusive", "published_at", "value"]
_EVENT_SELECT = ", ".join(_EVENT_COLUMNS)


def _scored(df, *columns):
    return df.select(*columns, F.round("score", 6).alias("score"))


# --- by time ----------------------------------------------------------------------------

@query("recent_news", f"""
WITH {Q.EVENTS}, hits AS (SELECT * FROM rows WHERE {_SINCE}){Q.collapsed('hits', 50)}
SELECT {_EVENT_SELECT} FROM newest""")
def recent_news(spark, sf):
    return recency.recent_news(X.event_rows(spark, sf), X.ASOF, HOURS).select(*_EVENT_COLUMNS)


@query("recent_news_filtered", f"""
WITH {Q.EVENTS}, hits AS (SELECT * FROM rows WHERE {_SINCE} AND category = 'click' AND is_exclusive){Q.collapsed('hits', 20)}
SELECT {_EVENT_SELECT} FROM newest""")
def recent_news_filtered(spark, sf):
    return recency.recent_news(X.event_rows(spark, sf), X.ASOF, HOURS, 20, "click", True).select(*_EVENT_COLUMNS)


@query("articles_by_date", f"""
WITH {Q.EVENTS}, hits AS (SELECT * FROM rows WHERE published_at >= DATE '{DAY}' AND published_at < DATE '{DAY}' + 1){Q.collapsed('hits')}
SELECT {_EVENT_SELECT} FROM newest""")
def articles_by_date(spark, sf):
    return recency.articles_by_date(X.event_rows(spark, sf), DAY).select(*_EVENT_COLUMNS)


@query("latest_articles", f"""
WITH {Q.EVENTS}, hits AS (SELECT * FROM rows WHERE published_at IS NOT NULL AND category = 'purchase'){Q.collapsed('hits', 5)}
SELECT {_EVENT_SELECT} FROM newest""")
def latest_articles(spark, sf):
    return recency.latest_articles(X.event_rows(spark, sf), category="purchase").select(*_EVENT_COLUMNS)


@query("collapse_articles", f"""
WITH {Q.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY published_at DESC, chunk_index) AS rn FROM rows)
SELECT {_EVENT_SELECT} FROM r WHERE rn = 1""")
def collapse_articles(spark, sf):
    from newsloom.operators.ranking import collapse

    return collapse(X.event_rows(spark, sf)).select(*_EVENT_COLUMNS)


@query("chunks_of_article", f"""
WITH {Q.CHUNKS}, longest AS (SELECT article_id FROM chunks GROUP BY article_id ORDER BY count(*) DESC, article_id LIMIT 1)
SELECT chunk_id, chunk_index, content FROM chunks WHERE article_id = (SELECT article_id FROM longest) ORDER BY chunk_index""")
def chunks_of_article(spark, sf):
    chunks = X.corpus(spark, sf)
    longest = chunks.groupBy("article_id").count().orderBy(F.col("count").desc(), "article_id").first()["article_id"]
    return recency.chunks_of_article(chunks, longest).select("chunk_id", "chunk_index", "content")


# --- corpus statistics ----------------------------------------------------------------------

@query("category_terms", """
SELECT event_type || '-' || user_id AS category, count(*) AS doc_count FROM events WHERE event_type <> 'error'
GROUP BY 1""")
def category_terms(spark, sf):
    category = F.when(F.col("category") != "error", F.concat_ws("-", "category", "article_id"))
    return recency.category_terms(X.event_rows(spark, sf).withColumn("category", category))


@query("database_stats", f"""
WITH {Q.CHUNKS}, terms AS (SELECT category, count(*) AS n FROM chunks WHERE category IS NOT NULL GROUP BY category)
SELECT count(*) AS total_chunks, count(DISTINCT article_id) AS total_articles, max(published_at) AS latest_date, min(published_at) AS oldest_date,
  (SELECT string_agg(category || '=' || n, ',' ORDER BY n DESC, category) FROM terms) AS categories FROM chunks""")
def database_stats(spark, sf):
    stats = recency.database_stats(X.corpus(spark, sf), exact=True)
    shown = F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["category"], c["doc_count"])), ",")
    return stats.withColumn("categories", shown)


@query("stats_from_sketches", f"""
WITH {Q.CHUNKS}, terms AS (SELECT category, count(*) AS n FROM chunks WHERE category IS NOT NULL GROUP BY category)
SELECT count(*) AS total_chunks, true AS close, max(published_at) AS latest_date, min(published_at) AS oldest_date,
  (SELECT string_agg(category || '=' || n, ',' ORDER BY n DESC, category) FROM terms) AS categories FROM chunks""")
def stats_from_sketches(spark, sf):
    """Statistics of three batches: two parts of the corpus, then the exclusive articles written again."""
    chunks, kept = X.corpus(spark, sf), BatchStats(scratch_path(spark, "stats"))
    first, again = F.col("published_at") < F.lit("2024-01-16").cast("timestamp_ntz"), chunks.filter("is_exclusive")
    kept.change("v1", chunks.filter(first))
    kept.change("v2", chunks.filter(~F.coalesce(first, F.lit(False))))
    kept.change("v3", again, again)
    exact = chunks.agg(F.count_distinct("article_id")).scalar()
    close = F.abs(F.col("total_articles") - exact) <= 0.03 * exact  # the deviation is 0.8 %
    shown = F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["category"], c["doc_count"])), ",")
    return kept.stats(spark).select("total_chunks", close.alias("close"), "latest_date", "oldest_date", shown.alias("categories"))


@query("approximate_articles", "SELECT count(*) AS total_chunks, true AS close FROM events")
def approximate_articles(spark, sf):
    """The sketch's article count against the exact one; its deviation is 5 %, so 15 % is three of them."""
    rows = X.event_rows(spark, sf)
    exact = rows.agg(F.count_distinct("article_id")).scalar()
    stats = recency.database_stats(rows)
    return stats.select("total_chunks", (F.abs(F.col("total_articles") - exact) <= 0.15 * exact).alias("close"))


# --- vectors -----------------------------------------------------------------------------------

_VECTOR_ROWS = """
rows AS (
  SELECT md5((vec_id % 50)::VARCHAR) AS article_id, vec_id::VARCHAR AS chunk_id, label::VARCHAR AS category,
         label > 4 AS is_exclusive, embedding AS content_vector FROM embeddings)"""
_NEAR = f"near AS (SELECT *, {Q.similarity('content_vector', VECTOR)} AS score FROM rows)"


@query("vector_search", f"""
WITH {_VECTOR_ROWS}, {_NEAR} SELECT chunk_id, article_id, round(score, 6) AS score FROM near ORDER BY near.score DESC, chunk_id LIMIT 20""")
def search_by_vector(spark, sf):
    return _scored(vector_search(X.vector_rows(spark, sf), VECTOR, 20), "chunk_id", "article_id")


@query("vector_search_filtered", f"""
WITH {_VECTOR_ROWS}, {_NEAR}, top AS (SELECT * FROM near WHERE category = '7' AND is_exclusive)
SELECT chunk_id, category, round(score, 6) AS score FROM top ORDER BY top.score DESC, chunk_id LIMIT 20""")
def vector_search_filtered(spark, sf):
    hits = vector_search(X.vector_rows(spark, sf), VECTOR, 20, category="7", exclusive_only=True, columns=["category"])
    return _scored(hits, "chunk_id", "category")


@query("vector_min_score", f"""
WITH {_VECTOR_ROWS}, {_NEAR}, top AS (SELECT * FROM near ORDER BY score DESC, chunk_id LIMIT 30)
SELECT chunk_id, round(score, 6) AS score FROM top WHERE score >= 0.66""")
def vector_min_score(spark, sf):
    return _scored(vector_search(X.vector_rows(spark, sf), VECTOR, 30, min_score=0.66), "chunk_id")


@query("similarity_scores", f"""
WITH {_VECTOR_ROWS}, {_NEAR} SELECT chunk_id, round(score, 6) AS score FROM near""")
def similarity_scores(spark, sf):
    from newsloom.operators.vector import similarity

    return X.vector_rows(spark, sf).select("chunk_id", F.round(similarity("content_vector", VECTOR), 6).alias("score"))


@query("best_per_article", f"""
WITH {_VECTOR_ROWS}, {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS rn FROM near)
SELECT article_id, chunk_id, round(score, 6) AS score FROM r WHERE rn = 1 ORDER BY r.score DESC, chunk_id LIMIT 25""")
def best_articles(spark, sf):
    from newsloom.operators.vector import similarity

    hits = X.vector_rows(spark, sf).withColumn("score", similarity("content_vector", VECTOR))
    return _scored(best_per_article(hits, 25), "article_id", "chunk_id")


# --- keywords ------------------------------------------------------------------------------------

_DOC_ROWS = "chunks AS (SELECT doc_id::VARCHAR AS chunk_id, \"text\" AS content FROM documents)"


def _doc_rows(spark, sf):
    return X.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("article_id"),
        F.col("text").alias("content"),
    )


@query("keyword_search", f"""
WITH {_DOC_ROWS}{Q.bm25(TEXT, {'content': 1.0})}
SELECT chunk_id, round(text_score, 6) AS score FROM text_scores ORDER BY text_score DESC, chunk_id LIMIT 20""")
def search_keywords(spark, sf):
    return _scored(keyword_search(_doc_rows(spark, sf), TEXT, 20, {"content": 1.0}), "chunk_id")


@query("keyword_search_fields", f"""
WITH {Q.CHUNKS}{Q.bm25(OTHER_TEXT, C.FIELD_BOOSTS)}
SELECT chunk_id, round(text_score, 6) AS score FROM text_scores ORDER BY text_score DESC, chunk_id LIMIT 20""")
def keyword_search_fields(spark, sf):
    return _scored(keyword_search(X.corpus(spark, sf), OTHER_TEXT, 20), "chunk_id")


@query("term_frequencies", f"""
WITH w AS (SELECT doc_id, unnest({Q.tokens('"text"')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY term""")
def term_frequencies(spark, sf):
    return postings(_doc_rows(spark, sf), ["content"]).groupBy("term").agg(
        F.count("*").alias("documents"), F.sum("tf").alias("occurrences")
    )


_POSTINGS: dict[tuple[str, str], PostingTable] = {}


def posting_table(spark, sf) -> PostingTable:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _POSTINGS:
        table = PostingTable(scratch_path(spark, "postings"), 16)
        _POSTINGS[key] = table.build(_doc_rows(spark, sf), ["content"]).at("base")
    return _POSTINGS[key]


_ASKED = 'asked AS (SELECT item_id AS query_id, item_id AS chunk_id, "text" AS content FROM benchmark)'


def _best_of_each(scores: str, k: int = 5) -> str:
    return f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {scores})
SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= {k}"""


def _batch_sql(rows: str) -> str:
    """Best five of ``rows (chunk_id, content)`` for every text of ``benchmark``."""
    return f"WITH {_ASKED}, rows AS ({rows}){Q.text_batch({'content': 1.0}, 'rows')}{_best_of_each('batch_text')}"


def _asked(spark, sf):
    return X.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _batch(index, spark, sf):
    return _scored(index.search(_asked(spark, sf), 5, {"content": 1.0}), "query_id", "rank", "chunk_id")


@query("keyword_batch", _batch_sql('SELECT doc_id::VARCHAR AS chunk_id, "text" AS content FROM documents'))
def keyword_batch(spark, sf):
    return _batch(posting_table(spark, sf), spark, sf)


_REVISED = "thin therin "


@query("index_after_upsert", _batch_sql(f"""
  SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN '{_REVISED}' ELSE '' END
    || "text" AS content FROM documents
  UNION ALL SELECT 'item' || item_id, "text" FROM benchmark"""))
def index_after_upsert(spark, sf):
    """Poor documents are written anew and the benchmark's texts come in: one batch over the index of all documents."""
    poor = X.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("chunk_id"))
    old = _doc_rows(spark, sf).join(poor, "chunk_id", "left_semi")
    item = F.concat(F.lit("item"), F.col("item_id").cast("string"))
    fresh = X.table(spark, sf, "benchmark").select(item.alias("chunk_id"), item.alias("article_id"), F.col("text").alias("content"))
    revised = old.withColumn("content", F.concat(F.lit(_REVISED), F.col("content")))
    index = posting_table(spark, sf).change("revised", revised.unionByName(fresh), old)
    return _batch(index.at("base", "revised"), spark, sf)


@query("index_after_delete", _batch_sql("""
  SELECT doc_id::VARCHAR AS chunk_id, "text" AS content FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def index_after_delete(spark, sf):
    """Toxic documents are deleted."""
    toxic = X.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id"))
    index = posting_table(spark, sf).change("deleted", removed=_doc_rows(spark, sf).join(toxic, "chunk_id", "left_semi"))
    return _batch(index.at("base", "deleted"), spark, sf)


# --- a table of queries ------------------------------------------------------------------------------

_CELLS: dict[tuple[str, str], VectorCells] = {}


def corpus_cells(spark, sf) -> VectorCells:
    """Cell index of the chunk table's vectors."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CELLS:
        _CELLS[key] = VectorCells(scratch_path(spark, "cells")).build(X.corpus(spark, sf), 32)
    return _CELLS[key]


def _probes(spark, sf):
    return X.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", embedding(F.col("text")).alias("vector"))


_NEAR_BATCH = f"""
WITH {Q.CHUNKS}{Q.vectors()}, {_ASKED}{Q.vectors('asked', name='probes')},
near AS (
  SELECT p.chunk_id AS query_id, v.chunk_id, (1.0::DOUBLE + CASE WHEN isnan(c) THEN 0 ELSE c END) / 2.0::DOUBLE AS score
  FROM probes p, vectors v, LATERAL (SELECT list_cosine_similarity(v.content_vector::DOUBLE[], p.content_vector::DOUBLE[]) AS c))"""


@query("vector_batch", f"{_NEAR_BATCH}{_best_of_each('near')}")
def vector_batch(spark, sf):
    return _scored(corpus_cells(spark, sf).search(_probes(spark, sf), 5), "query_id", "rank", "chunk_id")


@query("hybrid_batch", f"""{_NEAR_BATCH}{Q.text_batch(C.FIELD_BOOSTS, 'chunks')},
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS near_rank FROM near) WHERE near_rank <= 5),
hybrid AS (
  SELECT query_id, chunk_id, coalesce(n.score, 0) * {C.API_WEIGHTS[0]}::DOUBLE + coalesce(t.score, 0) * {C.API_WEIGHTS[1]}::DOUBLE AS score
  FROM nearest n FULL JOIN batch_text t USING (query_id, chunk_id)){_best_of_each('hybrid')}""")
def search_hybrid_batch(spark, sf):
    hits = hybrid_batch(_probes(spark, sf), corpus_cells(spark, sf), corpus_index(spark, sf), 5)
    return _scored(hits, "query_id", "rank", "chunk_id")


# --- hybrid and modes -----------------------------------------------------------------------------

def _top(k: int, source: str = "hybrid", columns: str = "chunk_id, article_id") -> str:
    return f"SELECT {columns}, round(score, 6) AS score FROM {source} ORDER BY {source}.score DESC, chunk_id LIMIT {k}"


_BASE = Q.CHUNKS + Q.vectors()


def _deduped(source: str, k: int) -> str:
    return f""",
best AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id) AS rn FROM {source}),
kept AS (SELECT b.chunk_id, b.article_id, b.score, c.title, c.is_exclusive FROM best b JOIN chunks c USING (chunk_id) WHERE rn = 1 ORDER BY b.score DESC, b.chunk_id LIMIT {k})
SELECT chunk_id, article_id, title, is_exclusive, round(score, 6) AS score FROM kept"""


_MODE_COLUMNS = ["chunk_id", "article_id", "title", "is_exclusive"]


def _engine(spark, sf) -> Engine:
    return Engine(X.corpus(spark, sf), X.ASOF, index=lambda: corpus_index(spark, sf))


@query("hybrid_search", f"WITH {_BASE}{Q.hybrid(TEXT, 10, C.API_WEIGHTS)} {_top(10)}")
def search_hybrid(spark, sf):
    return _scored(hybrid_search(X.corpus(spark, sf), TEXT, VECTOR, 10), "chunk_id", "article_id")


_INDEXES: dict[tuple[str, str], PostingTable] = {}


def corpus_index(spark, sf) -> PostingTable:
    """Posting table of the chunk table's four text fields."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = PostingTable(scratch_path(spark, "index"), 16).build(X.corpus(spark, sf))
    return _INDEXES[key]


@query("hybrid_indexed", f"WITH {_BASE}{Q.hybrid(TEXT, 10, C.API_WEIGHTS)} {_top(10)}")
def hybrid_indexed(spark, sf):
    hits = indexed_hits(X.corpus(spark, sf), corpus_index(spark, sf), [Query(TEXT, VECTOR)], 10)
    return _scored(hits, "chunk_id", "article_id")


@query("hybrid_indexed_filtered", f"""
WITH {_BASE}{Q.hybrid(TEXT, 20, C.API_WEIGHTS, where="AND c.category = 'src7' AND c.is_exclusive", pad=True)} {_top(10)}""")
def hybrid_indexed_filtered(spark, sf):
    hits = indexed_hits(X.corpus(spark, sf), corpus_index(spark, sf), [Query(TEXT, VECTOR)], 10, category="src7",
                        exclusive_only=True)
    return _scored(hits, "chunk_id", "article_id")


@query("hybrid_search_filtered", f"""
WITH {_BASE}{Q.hybrid(TEXT, 20, C.API_WEIGHTS, where="AND c.category = 'src7' AND c.is_exclusive", pad=True)} {_top(10)}""")
def hybrid_search_filtered(spark, sf):
    hits = hybrid_search(X.corpus(spark, sf), TEXT, VECTOR, 10, category="src7", exclusive_only=True)
    return _scored(hits, "chunk_id", "article_id")


@query("hybrid_search_strict", f"""
WITH {_BASE}{Q.hybrid(TEXT, 60, C.API_WEIGHTS, where="AND c.category = 'src3'")} {_top(30)}""")
def hybrid_search_strict(spark, sf):
    hits = hybrid_search(X.corpus(spark, sf), TEXT, VECTOR, 30, category="src3", pad_filtered=False)
    return _scored(hits, "chunk_id", "article_id")


@query("semantic_mode", f"""
WITH {_BASE}, near AS (SELECT v.chunk_id, c.article_id, {Q.similarity('content_vector', VECTOR)} AS score FROM vectors v JOIN chunks c USING (chunk_id))
{_deduped('near', 10)}""")
def semantic_mode(spark, sf):
    return _scored(_engine(spark, sf).semantic(TEXT, 10), *_MODE_COLUMNS)


@query("hybrid_mode", f"WITH {_BASE}{Q.hybrid(TEXT, 20, C.TOOL_WEIGHTS)}{_deduped('hybrid', 10)}")
def hybrid_mode(spark, sf):
    return _scored(_engine(spark, sf).hybrid(TEXT, 10), *_MODE_COLUMNS)


_NEWEST_COLUMNS = "chunk_id, article_id, title, is_exclusive"


@query("recent_mode", f"""
WITH {Q.CHUNKS}, hits AS (SELECT * FROM chunks WHERE {_SINCE} AND is_exclusive){Q.collapsed('hits', 5)}
SELECT {_NEWEST_COLUMNS} FROM newest""")
def recent_mode(spark, sf):
    return _engine(spark, sf).recent(HOURS, 5, exclusive_only=True).select(*_MODE_COLUMNS)


# nothing is that new, so the fallback answers, and it ignores exclusivity
@query("recent_fallback", f"""
WITH {Q.CHUNKS}, hits AS (SELECT * FROM chunks WHERE category = 'src2'){Q.collapsed('hits', 5)}
SELECT {_NEWEST_COLUMNS} FROM newest""")
def recent_fallback(spark, sf):
    engine = Engine(X.corpus(spark, sf), "2025-01-01 00:00:00")
    return engine.recent(24, 5, "src2", exclusive_only=True).select(*_MODE_COLUMNS)


@query("mode_dispatch", f"WITH {_BASE}{Q.hybrid(OTHER_TEXT, 12, C.TOOL_WEIGHTS)}{_deduped('hybrid', 6)}")
def mode_dispatch(spark, sf):
    # a mode nobody knows is hybrid, and the look-back is ignored there
    rows = _engine(spark, sf).execute(Intent(OTHER_TEXT, mode="surprise", hours_ago=1), 6)
    return _scored(rows, *_MODE_COLUMNS)


@query("news_query")
def news_query(spark, sf):
    rows = _engine(spark, sf).news_query(TEXT, 8)
    return rows.select(*_MODE_COLUMNS, F.round("score", 6).alias("score"), "quality", "mode")


@query("api_search", f"""
WITH {_BASE}{Q.hybrid(OTHER_TEXT, 25, C.API_WEIGHTS)}
SELECT h.chunk_id, title, url, round(h.score, 6) AS score FROM hybrid h JOIN chunks c USING (chunk_id) ORDER BY h.score DESC, h.chunk_id LIMIT 25""")
def api_search(spark, sf):
    from newsloom.plans.api import Api

    rows = Api(_engine(spark, sf)).search(OTHER_TEXT, 25)
    return _scored(rows, "chunk_id", "title", "url")


@query("api_recent", f"""
WITH {Q.CHUNKS}, hits AS (SELECT * FROM chunks WHERE published_at >= TIMESTAMP '{X.ASOF}' - INTERVAL 24 HOUR){Q.collapsed('hits', 20)}
SELECT chunk_id, title, url, published_at FROM newest""")
def api_recent(spark, sf):
    from newsloom.plans.api import Api

    return Api(_engine(spark, sf)).recent().select("chunk_id", "title", "url", "published_at")
