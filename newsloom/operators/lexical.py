"""Keyword search with BM25, over chunk text or over a stored posting table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom import constants as C
from newsloom.functions.providers import WORD_RE
from newsloom.functions.terms import STOP_SET, BatchTerms
from newsloom.functions.text import computed_once, tokens
from newsloom.operators.ranking import first_n
from newsloom.session import path_exists, remove_path, scratch_path, stored

#: Share of a query's postings, rarest terms first, that sets the first floor of a pruned search.
SEED_SHARE = 0.05
#: Texts scored in full for the floor, in multiples of the hits asked for.
TRIED = 4
#: Share of the floor that the greatest parts of the common terms may reach together.  More of it names fewer
#: candidates, less of it keeps fewer of those named.
COMMON_SHARE = 0.25
#: Floors are compared a little lower, as sums in another order round differently.
SLACK = 1.0 - 1e-9

_LIST = "field string, term string, block long, sign int, firsts int, at array<int>, tfs array<int>, lens array<int>"


def query_terms(text: str) -> dict[str, int]:
    """Terms of a query and how often each is asked for."""
    return dict(Counter(w for w in WORD_RE.findall(text.lower()) if w not in STOP_SET))


def inverse_frequency(docs: Column, having: Column) -> Column:
    return F.ln(1.0 + (docs - having + 0.5) / (having + 0.5))


def saturation(tf: Column, length: Column, mean_length: Column) -> Column:
    norm = C.BM25_K1 * (1.0 - C.BM25_B + C.BM25_B * length / mean_length)
    return tf / (tf + norm)


# --- scoring straight from the text --------------------------------------------

class TextScorer:
    """BM25 of several queries in one pass over the chunk text, without a shuffle.

    Each row keeps, per field, its length and the counts of the asked terms.
    The corpus statistics (row counts, mean lengths, term row counts) are one
    aggregated row that enters the scoring pass as a scalar subquery.  Query
    terms consist of letters and digits only, so they are safe inside SQL text.
    """

    def __init__(self, chunks: DataFrame, queries: Sequence[str], boosts: Mapping[str, float] = C.FIELD_BOOSTS):
        self.queries = [query_terms(q) for q in queries]
        self.terms = sorted(set().union(*self.queries)) if self.queries else []
        self.boosts = {f: b for f, b in boosts.items() if f in chunks.columns} if self.terms else {}
        self.chunks = chunks
        if not self.boosts:
            return
        asked = "array(" + ", ".join(f"'{t}'" for t in self.terms) + ")"
        keep = chunks.columns
        words = {f"_words_{f}": tokens(f) for f in self.boosts}
        rows = computed_once(chunks, keep, **words)
        found = {}
        for f in self.boosts:
            found[f"_len_{f}"] = F.size(f"_words_{f}")
            found[f"_hit_{f}"] = F.expr(f"filter(_words_{f}, w -> array_contains({asked}, w))")
        rows = computed_once(rows, keep, **found)
        self.rows = rows.selectExpr(
            *keep,
            *[f"_len_{f}" for f in self.boosts],
            *[f"transform({asked}, t -> size(filter(_hit_{f}, w -> w = t))) AS _tf_{f}" for f in self.boosts],
        )

    def _statistics(self) -> Column:
        """Struct with ``mean_<field>`` and per-query term weights ``w<i>_<field>``."""
        counts, weights = [], []
        for f in self.boosts:
            counts += [f"count_if(_len_{f} > 0) AS n_{f}", f"sum(CAST(_len_{f} AS BIGINT)) AS total_{f}"]
            counts += [f"count_if(_tf_{f}[{i}] > 0) AS df_{f}_{i}" for i in range(len(self.terms))]
            weights.append(f"total_{f} / nullif(CAST(n_{f} AS DOUBLE), 0D) AS mean_{f}")
            for q, asked in enumerate(self.queries):
                idf = [
                    f"{asked.get(t, 0)}D * ln(1D + (n_{f} - df_{f}_{i} + 0.5D) / (df_{f}_{i} + 0.5D))"
                    for i, t in enumerate(self.terms)
                ]
                weights.append(f"array({', '.join(idf)}) AS w{q}_{f}")
        totals = self.rows.groupBy().agg(*[F.expr(c) for c in counts])
        packed = totals.selectExpr(*weights)
        return packed.select(F.struct(*packed.columns).alias("stats")).scalar()

    def scored(self, *keep: str) -> DataFrame:
        """``keep`` columns plus ``text_0 .. text_n``: the best boosted field
        score of each query, 0 when none of its terms occurs."""
        if not self.boosts:
            return self.chunks.select(*keep, *[F.lit(0.0).alias(f"text_{i}") for i in range(len(self.queries))])
        scores = []
        for q in range(len(self.queries)):
            fields = []
            for f, boost in self.boosts.items():
                norm = f"{C.BM25_K1}D * ({1 - C.BM25_B}D + {C.BM25_B}D * _len_{f} / _stats.mean_{f})"
                part = f"zip_with(_tf_{f}, _stats.w{q}_{f}, (tf, w) -> if(tf > 0, w * tf / (tf + {norm}), 0D))"
                fields.append(f"{float(boost)}D * aggregate({part}, 0D, (a, x) -> a + x)")
            best = f"greatest({', '.join(fields)})" if len(fields) > 1 else fields[0]
            scores.append(f"coalesce({best}, 0D) AS text_{q}")
        return self.rows.withColumn("_stats", self._statistics()).selectExpr(*keep, *scores)


def keyword_search(
    chunks: DataFrame, text: str, k: int = 5, boosts: Mapping[str, float] = C.FIELD_BOOSTS
) -> DataFrame:
    """Top ``k`` chunks by BM25 with their keys; rows without a term never match."""
    keys = [c for c in ("bucket", "article_id", "chunk_id") if c in chunks.columns]
    scored = TextScorer(chunks, [text], boosts).scored(*keys).withColumnRenamed("text_0", "score")
    return (
        scored.filter(F.col("score") > 0)
        .orderBy(F.col("score").desc(), F.col("chunk_id").asc())
        .limit(k)
    )


# --- posting table ----------------------------------------------------------------

def term_counts(col: Column) -> Column:
    """``array<struct<term, tf>>`` of a text's distinct tokens, counted in its own task."""

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def count(texts: pa.Array) -> pa.Array:
        found = BatchTerms(texts.to_pylist())
        terms = pa.array(found.terms, pa.string()).take(pa.array(found.term))
        rows = pa.StructArray.from_arrays([terms, pa.array(found.count, pa.int32())], ["term", "tf"])
        offsets = np.searchsorted(found.row, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return count(col)


def postings(chunks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, article_id, chunk_id, len, first, term, tf)`` of every distinct token.

    Counting happens inside the row, so nothing is shuffled here.  ``first``
    marks one posting of each text, so texts can be counted without a distinct.
    """
    per_field = [
        chunks.select(F.lit(f).alias("field"), "article_id", "chunk_id", term_counts(F.col(f)).alias("terms"))
        for f in fields
    ]
    rows = per_field[0]
    for other in per_field[1:]:
        rows = rows.unionByName(other)
    keys = ["field", "article_id", "chunk_id"]
    length = F.aggregate("terms", F.lit(0), lambda a, t: a + t["tf"])
    rows = computed_once(rows, [*keys, "terms"], len=length)
    return rows.select(*keys, "len", F.posexplode("terms").alias("at", "t")).select(
        *keys, "len", (F.col("at") == 0).alias("first"), "t.term", "t.tf"
    )


#: Texts of a block, which bound a posting list, and the bytes of text counted at once.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
_LISTS = ("field string, term string, block long, sign int, firsts int, at array<int>, tfs array<int>, lens array<int>,"
          " articles array<string>, chunks array<string>")


def _pieces(batch: pa.RecordBatch, fields: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """A batch in blocks of at most ``BLOCK_ROWS`` rows of one sign, cut where ``BLOCK_BYTES`` of text are reached."""
    for sign in (1, -1):
        rows = batch.filter(pc.equal(batch.column("sign"), sign))
        size = np.zeros(len(rows), np.int64)
        for f in fields:
            size += pc.fill_null(pc.binary_length(rows.column(f)), 0).to_numpy().astype(np.int64)
        reached, start = np.cumsum(size), 0
        while start < len(rows):
            full = int(np.searchsorted(reached, (reached[start - 1] if start else 0) + BLOCK_BYTES, "right"))
            end = min(max(full, start + 1), start + BLOCK_ROWS, len(rows))
            yield rows.slice(start, end - start)
            start = end


def posting_lists(chunks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Postings of ``chunks`` (with ``sign``) as one row per block, field and term, and one row per block with its texts' keys.

    A posting is a place in its block, a count and a length, so a list takes a few
    bytes for each and no key is repeated.  Block numbers hold for one run of the
    tasks: the rows are to be stored before they are used.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 16
        for batch in batches:
            for piece in _pieces(batch, fields):
                yield from lists_of(piece, block)
                block += 1

    def lists_of(piece: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        sign = piece.column("sign")[0].as_py()
        whole = pa.array([0, len(piece)], pa.int32())
        keys = [pa.ListArray.from_arrays(whole, piece.column(c)) for c in ("article_id", "chunk_id")]
        yield batch_of(1, block, sign, articles=keys[0], chunks=keys[1])
        for f in fields:
            found = BatchTerms(piece.column(f).to_pylist())
            if not len(found.term):
                continue
            length = np.bincount(found.row, found.count, len(piece)).astype(np.int32)
            opening = np.flatnonzero(np.diff(found.row, prepend=-1))
            firsts = np.bincount(found.term[opening], minlength=len(found.terms))
            order = np.argsort(found.term, kind="stable")
            term, row = found.term[order], found.row[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            offsets = pa.array(np.append(starts, len(term)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (row, found.count[order], length[row])]
            names = pa.array(found.terms, pa.string()).take(pa.array(term[starts]))
            yield batch_of(len(starts), block, sign, field=pa.array([f] * len(starts)), term=names,
                           firsts=pa.array(firsts[term[starts]], pa.int32()), at=lists[0], tfs=lists[1], lens=lists[2])

    numbers, words = pa.list_(pa.int32()), pa.list_(pa.string())
    kinds = {"field": pa.string(), "term": pa.string(), "block": pa.int64(), "sign": pa.int32(), "firsts": pa.int32(),
             "at": numbers, "tfs": numbers, "lens": numbers, "articles": words, "chunks": words}

    def batch_of(size: int, block: int, sign: int, **columns: pa.Array) -> pa.RecordBatch:
        columns |= {"block": pa.array([block] * size, pa.int64()), "sign": pa.array([sign] * size, pa.int32())}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in kinds.items()], names=list(kinds))

    return chunks.select("article_id", "chunk_id", "sign", *fields).mapInArrow(emit, _LISTS)


@dataclass(frozen=True)
class PostingTable:
    """Postings by term bucket with their statistics, kept up to date as sums of batches.

    A batch adds the postings of new texts with ``sign`` 1 and those of texts that
    are gone with ``sign`` -1; row counts, word counts and row counts of terms are
    signed sums too.  Reading adds up, so a change costs what it changes.  A batch
    counts once its ``fields`` rows are there, which are written last; writing one
    again replaces it.  ``only`` names the batches to look at.

    Postings are lists by block of texts (:func:`posting_lists`); ``texts`` has the
    keys.  Sums are made by text number, a long of batch, block and place, and keys
    are looked up for the results.  A text with several entries, as one that was
    replaced, goes by the least of their numbers.

    A query reads only the buckets its terms fall into, and inside them, since the
    rows are sorted by term, only the row groups that can hold them.  The rebalanced
    write splits a bucket with a very common term over many files.
    """

    path: str
    buckets: int = 64
    only: tuple[str, ...] | None = None

    @staticmethod
    def bucket_of(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    # --- writing ------------------------------------------------------------------
    def build(self, chunks: DataFrame, fields: Sequence[str] = tuple(C.FIELD_BOOSTS)) -> "PostingTable":
        """Postings of ``chunks`` in place of all there were."""
        for name in ("fields", "terms", "lists", "texts"):
            remove_path(chunks.sparkSession, f"{self.path}/{name}")
        return self.change("base", added=chunks, fields=fields)

    def change(self, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None,
               fields: Sequence[str] | None = None) -> "PostingTable":
        """Add a batch: chunk rows that are new, and those, as they were, that are gone or replaced."""
        parts = [(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
        spark = parts[0][0].sparkSession
        fields = fields or [r["field"] for r in self._fields(spark).select("field").distinct().collect()]
        rows = None
        for chunks, sign in parts:
            absent = {f: F.lit(None).cast("string") for f in fields if f not in chunks.columns}
            signed = chunks.withColumns(absent).select("article_id", "chunk_id", *fields, F.lit(sign).alias("sign"))
            rows = signed if rows is None else rows.unionByName(signed)
        at, scratch = f"batch={batch}", scratch_path(spark, "posting-lists")
        posting_lists(rows, fields).write.parquet(scratch)
        made = spark.read.schema(_LISTS).parquet(scratch)
        keys = F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size("articles") - 1).alias("at"), "articles", "chunks"))
        made.filter("term IS NULL").select("block", keys).toDF("block", "at", "article_id", "chunk_id").write.mode(
            "overwrite").parquet(f"{self.path}/texts/{at}")
        (
            made.filter("term IS NOT NULL").drop("articles", "chunks")
            .withColumn("bucket", self.bucket_of(F.col("term"), self.buckets)).hint("rebalance", F.col("bucket"))
            .sortWithinPartitions("bucket", "term")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/lists/{at}")
        )
        remove_path(spark, scratch)
        # everything else comes from the stored lists; no text is read again
        kept = spark.read.schema(f"{_LIST}, bucket int").parquet(f"{self.path}/lists/{at}")
        ratio = F.array_min(F.zip_with("lens", "tfs", lambda n, tf: n / tf))
        words = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, tf: a + tf)
        terms = kept.groupBy("bucket", "field", "term").agg(
            F.sum(F.size("at") * F.col("sign")).alias("df"), F.max(F.array_max("tfs")).alias("max_tf"), F.min(ratio).alias("min_ratio"),
            F.sum(F.col("firsts") * F.col("sign")).alias("firsts"), F.sum(words * F.col("sign")).alias("words"))
        terms.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/{at}")
        # the fields' sums are their terms' sums: the lists are opened once
        sums = spark.read.schema("field string, firsts long, words long").parquet(f"{self.path}/terms/{at}")
        stats = sums.groupBy("field").agg(F.sum("firsts").alias("docs"), F.sum("words").alias("words"))
        named = spark.createDataFrame([(f,) for f in fields], "field string")
        named.join(stats, "field", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fields/{at}")
        return self

    def exists(self, spark: SparkSession) -> bool:
        return path_exists(spark, f"{self.path}/fields") and path_exists(spark, f"{self.path}/lists")

    # --- reading ------------------------------------------------------------------
    def at(self, *batches: str) -> "PostingTable":
        """The table as of these batches."""
        return replace(self, only=batches)

    def _seen(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        return rows.filter(F.col("batch").isin(batches))

    def _fields(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.schema("field string, docs long, words long, batch string").parquet(f"{self.path}/fields")
        return self._seen(rows, list(self.only)) if self.only else rows

    def _batches(self, spark: SparkSession) -> list[str]:
        return [r["batch"] for r in self._fields(spark).select("batch").distinct().collect()]

    @staticmethod
    def _text(batches: list[str]) -> Column:
        """Number of a text: batch, block and place in one long."""
        batch = F.element_at(F.create_map(*[F.lit(v) for i, b in enumerate(sorted(batches)) for v in (b, i)]), F.col("batch"))
        return F.shiftleft(batch.cast("long"), 46) + F.shiftleft(F.col("block"), 12) + F.col("at")

    def _texts(self, spark: SparkSession, batches: list[str]) -> DataFrame:
        """``text, article_id, chunk_id`` of every entry."""
        rows = spark.read.schema("block long, at int, article_id string, chunk_id string, batch string").parquet(f"{self.path}/texts")
        return self._seen(rows, batches).select(self._text(batches).alias("text"), "article_id", "chunk_id")

    def _reader(self, spark: SparkSession) -> "_Reader":
        batches = self._batches(spark)
        texts = self._texts(spark, batches)
        rows = self._seen(spark.read.schema(f"{_LIST}, batch string, bucket int").parquet(f"{self.path}/lists"), batches)
        entries = texts.groupBy("article_id", "chunk_id").agg(F.min("text").alias("least"), F.collect_list("text").alias("all"))
        again = entries.filter(F.size("all") > 1).select(F.explode("all").alias("text"), "least").filter("text <> least")
        again = stored(again, "repeated-texts")  # usually none, or what the batches replace
        return _Reader(rows, texts, None if again.isEmpty() else again, self._text(batches))

    def _weights(self, queries: DataFrame, boosts: Mapping[str, float]) -> DataFrame:
        """``(query_id, bucket, term, field, mean_len, weight, df, most)``: one row a query, term and field.

        ``most`` bounds what the term can add to a text, from the greatest count and
        the least length for each occurrence: both hold whatever the mean length is.
        """
        spark = queries.sparkSession
        asked = (
            queries.select("query_id", F.explode(tokens("text")).alias("term"))
            .groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))
            .withColumn("bucket", self.bucket_of(F.col("term"), self.buckets))
        )
        fields = self._fields(spark).groupBy("field").agg(F.sum("docs").cast("double").alias("docs"), F.sum("words").alias("words")).select(
            "field", "docs", (F.col("words") / F.col("docs")).alias("mean_len"))  # one row per field
        known = spark.read.schema("field string, term string, df long, max_tf int, min_ratio double, batch string, bucket int")
        terms = self._seen(known.parquet(f"{self.path}/terms"), self._batches(spark)).filter(F.col("field").isin(list(boosts)))
        wanted = (
            asked.join(terms, ["bucket", "term"]).groupBy("query_id", "bucket", "term", "field", "weight")
            .agg(F.sum("df").cast("double").alias("df"), F.max("max_tf").cast("double").alias("max_tf"),
                 F.min("min_ratio").alias("min_ratio")).filter(F.col("df") > 0)
        )
        boost = F.element_at(
            F.create_map(*[F.lit(v) for f, b in boosts.items() for v in (f, float(b))]), F.col("field")
        )
        weight = F.col("weight") * boost * inverse_frequency(F.col("docs"), F.col("df"))
        most = F.col("weight") / (1.0 + C.BM25_K1 * (
            (1.0 - C.BM25_B) / F.col("max_tf") + C.BM25_B * F.col("min_ratio") / F.col("mean_len")))
        return (
            wanted.join(F.broadcast(fields), "field")
            .select("query_id", "bucket", "term", "field", "mean_len", "df", "max_tf", "min_ratio", weight.alias("weight"))
            .withColumn("most", most).drop("max_tf", "min_ratio")
        )

    def _added(self, rows: DataFrame, boosts: Mapping[str, float]) -> DataFrame:
        """Sum of postings joined with weights: ``query_id, text``, ``part_<i>`` by field, ``live``."""
        part = F.col("sign") * F.col("weight") * saturation(F.col("tf").cast("double"), F.col("len").cast("double"), F.col("mean_len"))
        return rows.groupBy("query_id", "text").agg(
            *[F.sum(F.when(F.col("field") == f, part).otherwise(0.0)).alias(f"part_{i}") for i, f in enumerate(boosts)],
            F.sum("sign").alias("live"))

    @staticmethod
    def _best(columns: Sequence[Column]) -> Column:
        return F.greatest(*columns) if len(columns) > 1 else columns[0]

    def scores(self, queries: DataFrame, boosts: Mapping[str, float] = C.FIELD_BOOSTS) -> DataFrame:
        """``(query_id, article_id, chunk_id, score)`` of every matching chunk.

        Terms meet posting lists in an equi-join; adaptive execution broadcasts the
        term side when it is small and splits a hot term's partition when not.
        """
        read = self._reader(queries.sparkSession)
        weights = stored(self._weights(queries, boosts).drop("df", "most"), "query-weights")
        sums = self._added(read.met(weights), boosts)
        # postings of a text that is gone add up to nothing, but for rounding
        return read.named(sums.filter(F.col("live") > 0).select(
            "query_id", "text", self._best([F.col(f"part_{i}") for i in range(len(boosts))]).alias("score")))

    def scores_of(self, queries: DataFrame, pairs: DataFrame, boosts: Mapping[str, float] = C.FIELD_BOOSTS) -> DataFrame:
        """:meth:`scores` for given ``pairs (query_id, article_id, chunk_id)`` only; pairs without a shared term are left out."""
        read = self._reader(queries.sparkSession)
        # of a text's entries the least is its number
        numbers = pairs.join(read.texts, ["article_id", "chunk_id"]).groupBy("query_id", "article_id", "chunk_id").agg(F.min("text").alias("text"))
        weights = stored(self._weights(queries, boosts), "query-weights")
        return read.named(self._full(read, stored(numbers.select("query_id", "text"), "asked-texts"), weights, boosts))

    def _full(self, read: "_Reader", pairs: DataFrame, weights: DataFrame, boosts: Mapping[str, float]) -> DataFrame:
        """``query_id, text, score`` of stored ``pairs (query_id, text)``."""
        return self._added(read.of_texts(pairs, weights.drop("df", "most")), boosts).filter(F.col("live") > 0).select(
            "query_id", "text", self._best([F.col(f"part_{i}") for i in range(len(boosts))]).alias("score"))

    def search(self, queries: DataFrame, k: int, boosts: Mapping[str, float] = C.FIELD_BOOSTS) -> DataFrame:
        """Top ``k`` chunks of each row of ``queries(query_id, text)`` with their ``rank``."""
        order = [F.round("score", 9).desc(), F.col("chunk_id").asc()]
        return first_n(self.candidates(queries, k, boosts).rows, ["query_id"], order, k, "rank")

    def candidates(self, queries: DataFrame, k: int, boosts: Mapping[str, float] = C.FIELD_BOOSTS) -> "Candidates":
        """Scores of all chunks that may be among the first ``k`` of a query.

        The rarest terms of a query, ``SEED_SHARE`` of its postings, are added up
        first, and the best ``TRIED`` x ``k`` texts by them are scored in full: their
        k-th score is a floor for the k-th of all.  Terms whose greatest parts
        together stay below the floor cannot bring a text in by themselves, so only
        the others' postings name candidates.  A candidate is dropped if its sum and
        the greatest parts of the terms left stay below the floor; what remains
        meets the common terms' postings.
        """
        spark = queries.sparkSession
        numbered = {f: i for i, f in enumerate(boosts)}
        parts = [F.col(f"part_{i}") for i in range(len(boosts))]
        weights = stored(self._weights(queries, boosts), "query-weights")  # used four times, one row a query and term
        read = self._reader(spark)

        rarest = Window.partitionBy("query_id").orderBy("df", "term", "field")
        before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        total = F.sum("df").over(Window.partitionBy("query_id"))
        seeds = weights.withColumn("seed", before < F.greatest(total * SEED_SHARE, F.lit(float(k)))).filter("seed")
        seeded = self._added(read.met(seeds.drop("df", "most", "seed")), boosts)
        tried = first_n(seeded.filter("live > 0").select("query_id", "text", self._best(parts).alias("score")),
                        ["query_id"], [F.col("score").desc()], TRIED * k)
        floor = stored(self._floor(self._full(read, stored(tried.drop("score"), "query-tried"), weights, boosts), k), "query-floors")

        least = Window.partitionBy("query_id", "field").orderBy("most", "term")
        reach = F.sum("most").over(least.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        split = stored(weights.join(floor, "query_id", "left").withColumn(
            "common", F.coalesce(reach < F.col("floor") * COMMON_SHARE, F.lit(False))).drop("df", "floor"), "query-split")
        named = self._added(read.met(split.filter(~F.col("common")).drop("most", "common")), boosts)
        named = named.filter("live > 0")
        left = split.filter("common").groupBy("query_id").agg(
            *[F.sum(F.when(F.col("field") == f, F.col("most")).otherwise(0.0)).alias(f"left_{i}") for f, i in numbered.items()])
        hopes = [F.col(f"part_{i}") + F.coalesce(F.col(f"left_{i}"), F.lit(0.0)) for i in range(len(boosts))]
        kept = stored(
            named.join(floor, "query_id", "left").join(left, "query_id", "left")
            .filter(self._best(hopes) >= F.coalesce(F.col("floor") * SLACK, F.lit(0.0)))
            .select("query_id", "text", *[f"part_{i}" for i in range(len(boosts))]), "query-kept")
        more = read.of_texts(kept.select("query_id", "text"), split.filter("common").drop("most", "common"))
        both = kept.unionByName(self._added(more, boosts).drop("live"))
        rows = both.groupBy("query_id", "text").agg(*[F.sum(p).alias(f"part_{i}") for i, p in enumerate(parts)])
        return Candidates(named, kept, read.named(rows.select("query_id", "text", self._best(parts).alias("score"))))

    @staticmethod
    def _floor(scores: DataFrame, k: int) -> DataFrame:
        """``query_id, floor``: the k-th score of each query that has as many."""
        top = first_n(scores, ["query_id"], [F.col("score").desc()], k)
        return top.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")


@dataclass(frozen=True)
class _Reader:
    """Posting lists and texts as of some batches; ``again`` are further entries of a text with its number, None if there are none."""

    lists: DataFrame
    texts: DataFrame
    again: DataFrame | None
    number: Column

    def _opened(self, lists: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and ``text, tf, len, sign`` of each posting."""
        rows = lists.select(*keep, "sign", "batch", "block", F.inline(F.arrays_zip("at", "tfs", "lens"))).select(
            *keep, "sign", self.number.alias("text"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))
        if self.again is None:
            return rows
        return rows.join(self.again, "text", "left").withColumn("text", F.coalesce("least", "text")).drop("least")

    def _asked(self, weights: DataFrame) -> DataFrame:
        """Lists of the buckets that the terms of a stored table fall into."""
        return self.lists.filter(F.col("bucket").isin([r["bucket"] for r in weights.select("bucket").distinct().collect()]))

    def met(self, weights: DataFrame) -> DataFrame:
        """Postings of each query's terms; ``weights`` comes from a stored table, so its size is known before the join."""
        met = self._asked(weights).join(weights, ["bucket", "term", "field"])
        return self._opened(met, "query_id", "field", "weight", "mean_len")

    def of_texts(self, pairs: DataFrame, weights: DataFrame) -> DataFrame:
        """Postings of each query's terms in its texts ``pairs (query_id, text)``; both tables are stored ones.

        A list is opened once however many queries ask for its term, and only the
        postings of the asked texts are joined.
        """
        terms = weights.select("bucket", "term", "field").distinct()
        rows = self._opened(self._asked(weights).join(terms, ["bucket", "term", "field"], "left_semi"), "bucket", "term", "field")
        rows = rows.join(pairs.select("text").distinct(), "text", "left_semi")
        return rows.join(pairs.join(weights, "query_id"), ["bucket", "term", "field", "text"])

    def named(self, rows: DataFrame) -> DataFrame:
        """``query_id, text, score`` with the texts' keys."""
        return rows.join(self.texts, "text").select("query_id", "article_id", "chunk_id", "score")


@dataclass(frozen=True)
class Candidates:
    """Chunks named by the telling terms, those that were kept, and the kept ones' full scores."""

    named: DataFrame
    kept: DataFrame
    rows: DataFrame
