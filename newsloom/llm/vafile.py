"""Exact nearest vectors by inner product through a vector-approximation file.

Two tables are written, by tiles of at most ``TILE_ROWS`` vectors: the approximation
file has, for every component, the cell of a grid of ``CELLS`` cells a dimension in
four bits, and the grid's origin and widths; the other one has the exact integer
vectors.  A query's inner product with a cell has an upper and a lower bound.  The
first pass scans the approximation file and takes, for every query, the k-th best
lower bound over the whole file.  The second pass scans it again and names the
vectors whose upper bound reaches that value.  Only those are read exactly, in the
tiles that hold them, best bound first, until the k-th exact score passes every
bound that is left.

Queries come in blocks that meet every tile.  Scores leave a tile only if they
are among the query's k best there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.base import map_arrow, table, written

SCALE = 256
TILE_ROWS = 4096
QUERY_ROWS = 512
CELLS = 16
TILES_MET = 16              # tiles, about, that a copy of the query blocks meets
NAMED = 1 << 18             # candidates in one row of the second pass, about
EXACT_STEP = 16             # vectors read exactly at a time
TOP = 5
EVERY = 50                  # rows with ids divisible by this are queries


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, v``: floor(256 x) of the vectors that take part, as numbers.

    Vectors that are null, hold null or non-finite components, or have a null id
    take no part.
    """
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
            .filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
            .filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
            .select("vec_id", F.size("e").alias("dim"),
                    F.transform("e", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")).alias("v")))


def blocked(rows: DataFrame, size: int, label: str) -> DataFrame:
    """``block, dim, ids, data``: ``vec_id, dim, v`` rows packed into blocks of at most ``size`` rows."""
    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int):
            ids = np.concatenate([h[0] for h in held[dim]])
            data = np.concatenate([h[1] for h in held[dim]])
            held[dim] = []
            for at in range(0, len(ids), size):
                yield {"dim": [dim], "ids": [ids[at:at + size].tobytes()], "data": [data[at:at + size].tobytes()]}

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat, sizes = batch.column("v").flatten().to_numpy(zero_copy_only=False), dims.astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                data = flat[(starts[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim)
                held.setdefault(dim, []).append((batch.column("vec_id").to_numpy()[own], data))
                if sum(len(h[0]) for h in held[dim]) >= size:
                    yield from block(dim)
        for dim in held:
            if held[dim]:
                yield from block(dim)

    packed = map_arrow(rows, run, "dim int, ids binary, data binary")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), label)


def packed_cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Origin, widths and cells, two to a byte, of a tile's vectors."""
    low, high = data.min(axis=0), data.max(axis=0)
    width = np.maximum(np.ceil((high - low + 1) / CELLS), 1)
    cell = ((data - low) // width).astype(np.uint8)
    cell = np.pad(cell, ((0, 0), (0, cell.shape[1] % 2)))
    return low, width, (cell[:, ::2] | cell[:, 1::2] << 4).tobytes()


class Approximation:
    """Cells of a tile's vectors, unpacked, and the bounds of inner products with them."""

    def __init__(self, low: bytes, width: bytes, cells: bytes, rows: int):
        self.low, self.width = np.frombuffer(low, np.float64), np.frombuffer(width, np.float64)
        pairs = np.frombuffer(cells, np.uint8).reshape(rows, -1)
        self.cells = np.stack([pairs & 15, pairs >> 4], axis=2).reshape(rows, -1)[:, :len(self.low)]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, (queries, vectors); all values are whole and exact in doubles."""
        near = self.low + self.cells * self.width
        far = near + self.width - 1
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ near.T + down @ far.T, up @ far.T + down @ near.T


def _whole(x: np.ndarray) -> bool:
    """Whether inner products of such vectors stay exact in doubles."""
    return not x.size or float(np.abs(x).max()) ** 2 * 4 * x.shape[1] < 2 ** 53


def _vectors(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(data, np.float64).reshape(len(found), dim)


def approximation_file(tiles: DataFrame) -> DataFrame:
    """``block, dim, ids, low, width, cells`` of the tiles, written; cells are null where doubles are not exact."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, data = _vectors(row["ids"], row["data"], row["dim"])
                grid = packed_cells(data) if _whole(data) else None
                low, width, cells = (grid[0].tobytes(), grid[1].tobytes(), grid[2]) if grid else (None, None, None)
                yield {"block": [row["block"]], "dim": [row["dim"]], "ids": [row["ids"]], "low": [low], "width": [width],
                       "cells": [cells]}

    return written(map_arrow(tiles.select("block", "dim", "ids", "data"), run,
                             "block long, dim int, ids binary, low binary, width binary, cells binary"), "va-cells")


def _met(tiles: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query block beside every tile of its dimension.

    The tiles are dealt over parts and the query blocks repeated for each, so a key
    of the equi-join has some ``TILES_MET`` tiles, however many there are.
    """
    parts = max(-(-tiles.count() // TILES_MET), 1)
    spread = (queries.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
              .select("q_part", *[F.col(c).alias(f"q_{c}") for c in queries.columns]))
    dealt = tiles.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    return dealt.join(spread, (F.col("part") == F.col("q_part")) & (F.col("dim") == F.col("q_dim")))


def _bounds(row: dict, q: np.ndarray, side: int) -> np.ndarray | None:
    """Lower (0) or upper (1) bounds of a tile's approximation; None where doubles are not exact."""
    if row["cells"] is None or not _whole(q):
        return None
    return Approximation(row["low"], row["width"], row["cells"], len(row["ids"]) // 8).bounds(q)[side]


def named(batches):
    """Second pass: for a tile and a query block, which vectors can be among the best of which query."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            q_ids, q = _vectors(row["q_ids"], row["q_data"], row["dim"])
            upper = _bounds(row, q, 1)
            if upper is None:
                upper = np.full((len(q_ids), len(ids)), np.inf)
            upper[q_ids[:, None] == ids[None, :]] = -np.inf
            open_ = (upper >= np.frombuffer(row["q_least"], np.float64)[:, None]) & (upper > -np.inf)
            sizes = open_.sum(axis=1)
            share = np.cumsum(sizes) // NAMED
            for k in np.unique(share[sizes > 0]).tolist():
                mine = np.flatnonzero((share == k) & (sizes > 0))
                at = np.nonzero(open_[mine])[1].astype(np.int32)
                yield {"c_block": [row["block"]], "c_ids": [q_ids[mine].tobytes()], "c_data": [q[mine].tobytes()],
                       "sizes": [sizes[mine].astype(np.int32).tobytes()], "at": [at.tobytes()],
                       "upper": [upper[mine][open_[mine]].tobytes()]}


def _products(query: np.ndarray, data: np.ndarray) -> list[int]:
    """Inner products in whole numbers of any size."""
    mine = [int(a) for a in query]
    return [sum(a * int(b) for a, b in zip(mine, row)) for row in data]


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, tile_rows: int = TILE_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` best vectors for each query.

    Queries are the rows with an id divisible by ``every``; a query's own id is
    no candidate, ties go to the smaller id, and vectors of other lengths do not
    meet.  Rows that repeat an id are candidates each; a query that is repeated
    is asked once, with the first of its vectors in order of components.  An
    empty table gives an empty result.
    """
    rows = written(quantised(vectors), "vectors")
    tiles = blocked(rows, tile_rows, "va-tiles")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("s"))
    queries = blocked(asked.select("vec_id", "s.dim", "s.v").repartition(F.floor(F.col("vec_id") / (every * query_rows))),
                      query_rows, "va-queries")

    cells = approximation_file(tiles)

    def lower(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                q_ids, q = _vectors(row["q_ids"], row["q_data"], row["dim"])
                bound = _bounds(row, q, 0)
                if bound is None:
                    bound = np.full((len(q_ids), 1), -np.inf)
                else:
                    bound[q_ids[:, None] == ids[None, :]] = -np.inf
                best = -np.partition(-bound, min(top, bound.shape[1]) - 1, axis=1)[:, :top]
                keep = np.isfinite(best)
                yield {"query_id": np.repeat(q_ids, keep.sum(axis=1)), "bound": best[keep]}

    grid = ["dim", "ids", "low", "width", "cells"]
    bounds = map_arrow(_met(cells, queries).select(*grid, "q_ids", "q_data"), lower, "query_id long, bound double")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"))
    certain = (bounds.withColumn("at", F.row_number().over(best_first)).filter(F.col("at") <= top)
               .groupBy("query_id").agg(F.when(F.count("*") == top, F.min("bound")).alias("least")))

    # the bound travels with the query blocks; a query without k certain scores reads everything
    def with_bounds(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                known = {r["query_id"]: r["least"] for r in row["known"] or []}
                least = np.array([-np.inf if known.get(i) is None else known[i] for i in ids.tolist()])
                yield {"block": [row["block"]], "dim": [row["dim"]], "ids": [row["ids"]], "data": [row["data"]],
                       "least": [least.tobytes()]}

    def opened(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield {"query_id": ids, "block": np.full(len(ids), row["block"])}

    owners = map_arrow(queries.select("block", "ids"), opened, "query_id long, block long")
    known = (owners.join(certain, "query_id").groupBy("block")  # query_rows entries at most
             .agg(F.collect_list(F.struct("query_id", "least")).alias("known")))
    limited = written(map_arrow(queries.join(known, "block", "left"), with_bounds,
                                "block long, dim int, ids binary, data binary, least binary"), "va-limits")

    def exact(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, data = _vectors(row["ids"], row["data"], row["dim"])
                q_ids, q = _vectors(row["c_ids"], row["c_data"], row["dim"])
                whole = _whole(data) and _whole(q)
                ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
                at, upper = np.frombuffer(row["at"], np.int32), np.frombuffer(row["upper"], np.float64)
                out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
                for query_id, query, own, bound in zip(q_ids.tolist(), q, np.split(at, ends[:-1]), np.split(upper, ends[:-1])):
                    if whole:
                        first = np.argsort(-bound, kind="stable")
                        found = _best(own[first], bound[first], ids, data, query, top)
                    else:
                        worst_last = sorted((-score, int(i)) for score, i in zip(_products(query, data[own]), ids[own]))
                        found = [(i, -score) for score, i in worst_last[:top]]
                    for vec_id, score in found:
                        for name, value in zip(out, (query_id, vec_id, score)):
                            out[name].append(value)
                yield out

    candidates = map_arrow(_met(cells, limited).select("block", *grid, "q_ids", "q_data", "q_least"), named,
                           "c_block long, c_ids binary, c_data binary, sizes binary, at binary, upper binary")
    asked_for = tiles.join(candidates, F.col("block") == F.col("c_block"))
    scores = map_arrow(asked_for.select("dim", "ids", "data", "c_ids", "c_data", "sizes", "at", "upper"), exact,
                       "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


def _best(order: np.ndarray, upper: np.ndarray, ids: np.ndarray, data: np.ndarray, query: np.ndarray,
          top: int) -> list[tuple[int, int]]:
    """The best exact scores of the vectors at ``order``, read by falling bounds until no bound can change them."""
    best: list[tuple[int, int]] = []
    for at in range(0, len(order), EXACT_STEP):
        part = order[at:at + EXACT_STEP]
        if len(best) == top and upper[at] < -best[-1][0]:
            break
        best = sorted(best + [(-int(s), int(i)) for s, i in zip(data[part] @ query, ids[part])])[:top]
    return [(vec_id, -score) for score, vec_id in best]


def op7_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
