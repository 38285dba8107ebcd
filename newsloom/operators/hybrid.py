"""Vector and keyword search combined, for one query or a handful at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsloom import constants as C
from newsloom.operators import filters
from newsloom.operators.cells import VectorCells
from newsloom.operators.lexical import PostingTable, TextScorer
from newsloom.operators.ranking import first_n
from newsloom.operators.vector import row_keys, similarities, with_rows
from newsloom.session import stored


@dataclass(frozen=True)
class Query:
    """A query text with its vector; ``name`` labels its rows in a batch."""

    text: str
    vector: Sequence[float]
    name: str = ""


def _vector_cutoffs(chunks: DataFrame, queries: Sequence[Query], fetch: int):
    """Array with the worst kept ``(-score, chunk_id)`` of each query.

    A row is among the nearest exactly when its pair is not above the cutoff,
    which replaces the join between vector hits and keyword hits.
    """
    vectors = chunks.filter(F.col("content_vector").isNotNull())
    key = F.struct((-F.col("near")).alias("s"), F.col("chunk_id").alias("c")).alias("key")
    rows = vectors.select("chunk_id", F.posexplode(_similarities(queries)).alias("q", "near")).select("q", key)
    if len(queries) == 1:
        top = rows.orderBy("key").limit(fetch)
    else:
        top = first_n(rows, ["q"], [F.col("key").asc()], fetch)
    return top.agg(F.array(*[
        F.max(F.when(F.col("q") == i, F.col("key"))) for i in range(len(queries))
    ]).alias("cutoffs")).scalar()


def _similarities(queries: Sequence[Query]):
    return similarities("content_vector", [q.vector for q in queries])


def hybrid_hits(
    chunks: DataFrame,
    queries: Sequence[Query],
    k: int = 5,
    weights: tuple[float, float] = C.API_WEIGHTS,
    category: str | None = None,
    exclusive_only: bool = False,
    pad_filtered: bool = True,
    articles: int | None = None,
) -> DataFrame:
    """``(name, keys, article_id, score)`` of the top ``k`` chunks of each query.

    With ``articles`` the best chunk of each article is kept first, and that many
    articles come back; ``k`` then only says how near a vector has to be.

    Score = vector weight x similarity (only for the nearest ``k``, or ``2k``
    when filtered) + text weight x BM25.  A filter turns both clauses optional,
    so filtered searches are padded with score-0 rows unless told otherwise.
    """
    condition = filters.wanted(category, exclusive_only)
    fetch = k if condition is None else 2 * k
    vector_weight, text_weight = weights
    keys = row_keys(chunks)
    keep = list(dict.fromkeys([*keys, "article_id", "content_vector", "category", "is_exclusive"]))
    scored = TextScorer(chunks, [q.text for q in queries]).scored(*keep)
    scored = filters.apply(scored, condition)
    # one row per query from here on: its number, vector score and text score
    texts = F.array(*[F.col(f"text_{i}") for i in range(len(queries))])
    nothing = F.array_repeat(F.lit(None).cast("double"), len(queries))
    near = F.coalesce(_similarities(queries), nothing)
    pairs = F.arrays_zip(near.alias("near"), texts.alias("text"))
    ids = list(dict.fromkeys([*keys, "article_id"]))
    rows = scored.select(*ids, F.posexplode(pairs).alias("q", "pair")).select(
        *ids, "q", F.col("pair.near").alias("near"), F.col("pair.text").alias("text")
    )
    cut = F.get(_vector_cutoffs(chunks, queries, fetch), F.col("q"))
    own = F.struct((-F.col("near")).alias("s"), F.col("chunk_id").alias("c"))
    rows = rows.withColumn("nearby", F.coalesce(F.col("near").isNotNull() & (own <= cut), F.lit(False)))
    if condition is None or not pad_filtered:
        rows = rows.filter(F.col("nearby") | (F.col("text") > 0))
    vector_part = F.when(F.col("nearby"), F.col("near") * vector_weight).otherwise(0.0)
    name = F.get(F.array(*[F.lit(q.name) for q in queries]), F.col("q"))
    rows = rows.select(*ids, name.alias("name"), (vector_part + F.col("text") * text_weight).alias("score"))

    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    return _top(rows, "name", order, k, articles, len(queries))


def _top(rows: DataFrame, key: str, order: list, k: int, articles: int | None, queries: int) -> DataFrame:
    if articles is not None:
        rows, k = first_n(rows, [key, "article_id"], order, 1), articles
    return rows.orderBy(*order).limit(k) if queries == 1 else first_n(rows, [key], order, k)


def indexed_hits(
    chunks: DataFrame,
    index: PostingTable,
    queries: Sequence[Query],
    k: int = 5,
    weights: tuple[float, float] = C.API_WEIGHTS,
    articles: int | None = None,
    category: str | None = None,
    exclusive_only: bool = False,
    pad_filtered: bool = True,
) -> DataFrame:
    """:func:`hybrid_hits` from a posting table.

    Reads the vectors, the filter columns and the postings of the asked terms, no
    chunk text.  The two score lists are added up by key, which is a full outer
    join on it.  The hits are stored, so joins with them know how few they are and
    do not shuffle the chunks.
    """
    condition = filters.wanted(category, exclusive_only)
    fetch = k if condition is None else 2 * k
    vector_weight, text_weight = weights
    spark = chunks.sparkSession
    keys = ["query_id", "article_id", "chunk_id"]
    vectors = chunks.filter(F.col("content_vector").isNotNull())
    near = vectors.select("article_id", "chunk_id", F.posexplode(_similarities(queries)).alias("query_id", "near"))
    order = [F.col("near").desc(), F.col("chunk_id").asc()]
    near = near.orderBy(*order).limit(fetch) if len(queries) == 1 else first_n(near, ["query_id"], order, fetch)
    asked = spark.createDataFrame([(i, q.text) for i, q in enumerate(queries)], "query_id int, text string")
    both = near.select(*keys, (F.col("near") * vector_weight).alias("part")).unionByName(
        index.scores(asked).select(*keys, (F.col("score") * text_weight).alias("part"))
    )
    if condition is not None:
        allowed = chunks.filter(condition).select("article_id", "chunk_id")
        both = both.join(allowed, ["article_id", "chunk_id"], "left_semi")
        if pad_filtered:
            # only the first of them can be needed to fill a result up
            spare = allowed if articles is None else first_n(allowed, ["article_id"], [F.col("chunk_id").asc()], 1)
            spare = spare.orderBy("chunk_id").limit(k if articles is None else articles)
            every = F.explode(F.array(*[F.lit(i) for i in range(len(queries))])).alias("query_id")
            both = both.unionByName(spare.select("article_id", "chunk_id", every, F.lit(0.0).alias("part")))
    rows = both.groupBy(*keys).agg(F.sum("part").alias("score"))
    top = [F.col("score").desc(), F.col("chunk_id").asc()]
    rows = _top(rows, "query_id", top, k, articles, len(queries))
    name = F.get(F.array(*[F.lit(q.name) for q in queries]), F.col("query_id"))
    rows = stored(rows.select("chunk_id", "article_id", name.alias("name"), "score"), "hybrid-hits")
    if "bucket" in chunks.columns:
        # the bucket lets the rows' text be read from their buckets only
        rows = stored(chunks.select("bucket", "article_id", "chunk_id").join(rows, ["article_id", "chunk_id"]), "hybrid-rows")
    return rows


def hybrid_batch(
    queries: DataFrame, cells: VectorCells, index: PostingTable, k: int = 5, weights: tuple[float, float] = C.API_WEIGHTS,
    boosts: Mapping[str, float] = C.FIELD_BOOSTS,
) -> DataFrame:
    """``query_id, rank, article_id, chunk_id, score`` of the ``k`` best chunks of ``queries (query_id, text, vector)``.

    :func:`hybrid_hits` for a table of queries.  The vector part counts for the ``k``
    nearest only, so every other hit is among the ``2 k`` best by text: both lists
    come from their indexes, the nearest get their text scores by key, and no chunk
    meets more queries than these lists say.
    """
    vector_weight, text_weight = weights
    keys = ["query_id", "article_id", "chunk_id"]
    near = stored(cells.search(queries, k).select(*keys, "score"), "hybrid-near")
    asked = queries.select("query_id", "text")
    text = index.search(asked, 2 * k, boosts).select(*keys, "score").unionByName(
        index.scores_of(asked, near.select(*keys), boosts)).groupBy(*keys).agg(F.max("score").alias("score"))
    both = near.withColumn("score", F.col("score") * vector_weight).unionByName(
        text.withColumn("score", F.col("score") * text_weight))
    rows = both.groupBy(*keys).agg(F.sum("score").alias("score"))
    return first_n(rows, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], k, "rank")


def hybrid_search(
    chunks: DataFrame,
    text: str,
    vector: Sequence[float],
    k: int = 5,
    weights: tuple[float, float] = C.API_WEIGHTS,
    category: str | None = None,
    exclusive_only: bool = False,
    pad_filtered: bool = True,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Top ``k`` chunk rows of one query, best first."""
    hits = hybrid_hits(chunks, [Query(text, vector)], k, weights, category, exclusive_only, pad_filtered)
    rows = with_rows(hits.drop("name"), chunks, columns)
    return rows.orderBy(F.col("score").desc(), F.col("chunk_id").asc()).limit(k)
