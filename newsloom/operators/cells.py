"""Exact nearest neighbours of a table of queries, from vectors kept in cells.

Vectors are put into the cells of a k-means model and stored by cell in tiles of
``TILE_ROWS``; each cell keeps its centre and the distance of its farthest vector.
By the triangle inequality a vector of a cell is no nearer to a query than the
query's distance to the centre less that radius, which bounds the cell's best score.
A query first reads the cells with the best bounds until they hold enough vectors;
its k-th score there is a floor, and of the other cells only those are read whose
bound reaches it.  Every result is therefore exact; how many cells that takes is
returned beside it.

Queries travel in blocks: a task meets one tile with one block and returns ``k`` rows
a query, whatever the size of either table.  Centres are one row a cell, a number the
caller chooses, and the only thing that goes to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators.ranking import first_n
from newsloom.session import stored

TILE_ROWS = 2048
QUERY_BLOCK = 256
#: Vectors of the k-means sample for each cell; the sample settles only how tight cells are.
SAMPLED = 100
#: Cells a query reads before it has a floor, if they hold ``k`` vectors.
FIRST_CELLS = 2
#: Scores and bounds of another order of summation.
SLACK = 1e-9
#: Where vectors of length zero go: their score is 0.5 for every query.
NO_DIRECTION = -1


def _matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1) if len(vectors) else values.reshape(0, 1)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((rows * rows).sum(axis=1))
    return np.divide(rows, length[:, None], out=np.zeros_like(rows), where=length[:, None] > 0), length


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(axis=1)[:, None] - 2.0 * (rows @ centres.T) + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


@dataclass(frozen=True)
class VectorCells:
    """Vectors by cell below ``path``: ``tiles/cell=<c>`` and one row a cell in ``cells``."""

    path: str

    def build(self, chunks: DataFrame, cells: int = 64) -> "VectorCells":
        """Cells of ``chunks (article_id, chunk_id, content_vector)``; null vectors and odd lengths stay out."""
        spark = chunks.sparkSession
        usable = chunks.select("article_id", "chunk_id", F.col("content_vector").cast("array<float>").alias("vector")).filter(
            F.size("vector") > 0)
        lengths = usable.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
        if lengths is None:
            raise ValueError("no vectors to index")
        usable = usable.filter(F.size("vector") == lengths["dim"])
        sample = usable.sample(min(1.0, SAMPLED * cells / lengths["count"]), seed=1)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        unit = F.transform("vector", lambda x: x / F.col("norm"))
        points = sample.withColumn("norm", norm).filter("norm > 0").select(array_to_vector(unit).alias("features"))
        points = stored(points.select("features"), "cell-sample")
        if points.isEmpty():
            centres = np.zeros((0, lengths["dim"]))
        else:
            model = KMeans(k=max(2, cells), seed=1, maxIter=5, initSteps=1).fit(points)
            centres = np.array([c for c in model.clusterCenters()])

        @F.arrow_udf("struct<cell:int,far:double>")
        def place(vectors: pa.Array) -> pa.Array:
            rows, length = _unit(_matrix(vectors))
            cell, far = np.full(len(rows), NO_DIRECTION, np.int32), np.zeros(len(rows))
            if len(centres):
                apart = _distances(rows, centres)
                nearest = apart.argmin(axis=1)
                has = length > 0
                cell[has], far[has] = nearest[has], apart[np.arange(len(rows)), nearest][has]
            return pa.StructArray.from_arrays([pa.array(cell), pa.array(far)], ["cell", "far"])

        placed = stored(usable.select("article_id", "chunk_id", "vector", place("vector").alias("p"))
                        .select("article_id", "chunk_id", "vector", "p.cell", "p.far"), "cell-rows")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        sizes = sizes.withColumn("tiles", F.ceil(F.col("n") / TILE_ROWS).cast("int"))
        middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        sizes.join(middle, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        tile = F.pmod(F.xxhash64("chunk_id"), F.col("tiles")).cast("int")
        (
            placed.join(sizes.select("cell", "tiles"), "cell").withColumn("tile", tile)
            .groupBy("cell", "tile").agg(F.collect_list(F.struct("article_id", "chunk_id", "vector")).alias("rows"))
            .write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/tiles")
        )
        return self

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("cell int, n long, radius double, tiles int, centre array<double>").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, rank, article_id, chunk_id, score, cells_read`` of the ``k`` nearest of each query.

        ``queries (query_id, vector)``: null vectors and those of another length have
        no neighbours.  Score is ``(1 + cosine) / 2``, 0.5 where a length is zero;
        ties go to the smaller ``chunk_id``.
        """
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        first = stored(self._route(asked, None, k), "cell-first")
        near = stored(self._scan(first, k), "cell-near")
        floor = (first_n(near, ["query_id"], [F.col("score").desc()], k).groupBy("query_id")
                 .agg(F.min("score").alias("floor"), F.count("*").alias("n"))
                 .select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor")))
        seen = first.groupBy("query_id", "vector").agg(F.collect_set("cell").alias("seen")).join(floor, "query_id", "left")
        rest = stored(self._route(seen, "floor", k), "cell-rest")
        hits = near.unionByName(self._scan(rest, k))
        order = [F.round("score", 9).desc(), F.col("chunk_id").asc()]
        read = first.select("query_id", "cell").unionByName(rest.select("query_id", "cell")).groupBy("query_id").agg(
            F.count("*").alias("cells_read"))
        return first_n(hits, ["query_id"], order, k, "rank").join(read, "query_id").select(
            "query_id", "rank", "article_id", "chunk_id", "score", "cells_read")

    def _route(self, asked: DataFrame, floor: str | None, k: int) -> DataFrame:
        """``query_id, vector, cell``: the best cells of each query, or without a floor column the first to read."""
        spark = asked.sparkSession
        rows = self.cells(spark).orderBy("cell").collect()  # one row a cell
        dim = max((len(r["centre"]) for r in rows if r["centre"]), default=0)
        number = np.array([r["cell"] for r in rows], np.int32)
        size = np.array([r["n"] for r in rows])
        radius = np.array([r["radius"] for r in rows])
        centre = np.array([r["centre"] or [0.0] * dim for r in rows]).reshape(len(rows), dim)

        @F.arrow_udf("array<int>")
        def best(vectors: pa.Array, floors: pa.Array, seen: pa.Array) -> pa.Array:
            out = []
            for vector, least, known in zip(vectors.to_pylist(), floors.to_pylist(), seen.to_pylist()):
                if vector is None or (dim and len(vector) != dim):
                    out.append([])
                    continue
                unit, length = _unit(np.asarray([vector]))
                apart = np.maximum(_distances(unit, centre)[0] - radius, 0.0) if dim else np.zeros(len(rows))
                bound = (2.0 - apart * apart / 2.0) / 2.0
                if not length[0]:
                    bound[:] = 0.5
                bound[number == NO_DIRECTION] = 0.5
                order = np.lexsort((number, -bound))
                if known is None:
                    enough = int(np.searchsorted(np.cumsum(size[order]), k)) + 1
                    chosen = order[:max(FIRST_CELLS, enough)]
                else:
                    reach = -np.inf if least is None else least - SLACK
                    chosen = order[(bound[order] >= reach) & ~np.isin(number[order], known)]
                out.append(number[chosen].tolist())
            return pa.array(out, pa.list_(pa.int32()))

        if floor is None:
            asked = asked.withColumns({"floor": F.lit(None).cast("double"), "seen": F.lit(None).cast("array<int>")})
        return asked.select("query_id", "vector", F.explode(best("vector", "floor", "seen")).alias("cell"))

    def _scan(self, routes: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of each tile and query; tiles are read from the cells that ``routes`` names."""
        spark = routes.sparkSession
        asked = max(1, routes.select("query_id").distinct().count())
        block = F.pmod(F.xxhash64("query_id"), F.lit(-(-asked // QUERY_BLOCK)))
        # stored, so that Spark knows its size before the join and need not shuffle the tiles
        blocks = stored(routes.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked")), "cell-asked")
        kind = routes.schema["query_id"].dataType.simpleString()
        tiles = spark.read.schema(
            "tile int, rows array<struct<article_id:string,chunk_id:string,vector:array<float>>>, cell int").parquet(f"{self.path}/tiles")

        @F.arrow_udf(f"array<struct<query_id:{kind},article_id:string,chunk_id:string,score:double>>")
        def nearest(tile: pa.Array, asked: pa.Array) -> pa.Array:
            out = []
            for rows, wanted in zip(tile, asked):
                rows, wanted = rows.values, wanted.values
                data, probes = _matrix(pc.struct_field(rows, "vector")), _matrix(pc.struct_field(wanted, "vector"))
                articles, chunks = pc.struct_field(rows, "article_id"), pc.struct_field(rows, "chunk_id")
                own = np.sqrt((data * data).sum(axis=1))
                found = []
                for name, probe in zip(pc.struct_field(wanted, "query_id").to_pylist(), probes):
                    length = own * np.sqrt((probe * probe).sum())
                    cosine = np.divide((data * probe).sum(axis=1), length, out=np.zeros(len(data)), where=length > 0)
                    score = (cosine + 1.0) / 2.0
                    shown = np.round(score, 9)
                    top = np.arange(len(score))
                    if len(score) > k:  # all ties of the k-th stay for the ids to decide
                        top = np.flatnonzero(shown >= np.partition(shown, -k)[-k])
                    ids = chunks.take(pa.array(top)).to_pylist()
                    order = sorted(range(len(top)), key=lambda j: (-shown[top[j]], ids[j]))[:k]
                    names = articles.take(pa.array(top[order])).to_pylist()
                    found += [{"query_id": name, "article_id": a, "chunk_id": ids[j], "score": float(score[top[j]])}
                              for a, j in zip(names, order)]
                out.append(found)
            return pa.array(out, nearest_type)

        nearest_type = pa.list_(pa.struct([
            ("query_id", _ARROW[kind]), ("article_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())]))
        # the filter lets Spark prune the cells nobody asked for
        met = tiles.join(blocks.filter(F.size("asked") > 0), "cell")
        return met.select(F.explode(nearest("rows", "asked")).alias("hit")).select("hit.*")


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
