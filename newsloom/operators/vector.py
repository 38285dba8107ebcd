"""Exact nearest-neighbour search by cosine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators import filters
from newsloom.operators.ranking import first_n


def similarities(vector: str, queries: Sequence[Sequence[float]]) -> Column:
    """``array<double>`` of ``(1 + cosine) / 2`` to each query.

    Zero vectors score 0.5; a missing vector or one of another length is null.
    Each row is summed on its own in double precision, so it scores the same in
    every batch and every plan.  Numpy over Arrow batches, as Spark's array
    lambdas box every single element.
    """
    probes = np.asarray(queries, dtype=np.float64)
    lengths = np.sqrt((probes * probes).sum(axis=1))

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        count, dim = probes.shape
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
        rows = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        own = np.sqrt((rows * rows).sum(axis=1))
        cosines = np.zeros((len(rows), count))
        for i in range(count):
            size = own * lengths[i]
            np.divide((rows * probes[i]).sum(axis=1), size, out=cosines[:, i], where=size > 0)
        usable = fits.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(usable * count)]).astype(np.int32)
        values = pa.array(((cosines + 1.0) / 2.0).ravel())
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~usable))

    return score(F.col(vector))


def similarity(vector: str, query: Sequence[float]) -> Column:
    """Score of one query."""
    return F.get(similarities(vector, [query]), 0)


def row_keys(chunks: DataFrame) -> list[str]:
    """Columns that identify a chunk row; the table's bucket lets a join prune."""
    return [c for c in ("bucket", "chunk_id") if c in chunks.columns]


def scored(chunks: DataFrame, query: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """Keys and scores of all chunks; reads no text."""
    keys = row_keys(chunks)
    return chunks.select(
        *dict.fromkeys([*keys, *keep]), F.explode(similarities("content_vector", [query])).alias("score"))


def with_rows(hits: DataFrame, chunks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add display columns to hits; adaptive execution picks the join from their measured size."""
    keys = row_keys(chunks)
    missing = [c for c in columns if c not in hits.columns]
    if not missing:
        return hits
    rows = chunks.select(*keys, *[c for c in missing if c not in keys])
    # every score passes; Spark prunes partitions only for a side with a filter
    return rows.join(hits.filter(F.col("score") >= -1.0), keys)


def vector_search(
    chunks: DataFrame,
    query: Sequence[float],
    k: int = 5,
    min_score: float = 0.0,
    category: str | None = None,
    exclusive_only: bool = False,
    columns: Sequence[str] = (),
    per_article: bool = False,
) -> DataFrame:
    """Top ``k`` chunks by similarity of those that pass the filters.

    ``per_article`` keeps the best chunk of each article before the cut, so ``k``
    articles come back wherever ``k`` match.
    """
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    rows = filters.apply(chunks, filters.wanted(category, exclusive_only))
    hits = scored(rows, query, ["article_id"])
    if min_score > 0:
        hits = hits.filter(F.col("score") >= min_score)
    if per_article:
        hits = first_n(hits, ["article_id"], order, 1)
    return with_rows(hits.orderBy(*order).limit(k), chunks, columns).orderBy(*order).limit(k)
