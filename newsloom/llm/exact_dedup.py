"""Exact duplicates through an extendible-hash index on shared files.

Every text has a 64-bit key.  The index holds one entry per distinct key; its
directory starts with one bucket and doubles while a bucket is overfull, so a
bucket is a range of keys.  Owner tasks each take buckets with the rows of the
keys that occur more than once, chain texts under a key and compare their bytes.

A chain longer than a page (a text with very many copies) is cut into overflow
pages by a hash of the document id.  Owners resolve the pages first; a second
step compares only the first text of each page, so no task ever holds or
receives a group of copies whole.  Texts of documents with a key of their own
are read but never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import map_arrow, small_batches, table, unused, utf8, written

MAX_DEPTH = 14          # the directory has at most 2 ** MAX_DEPTH cells
PAGE_ROWS = 512
MOST_SENT = 200_000     # dropped rows, 80 bytes each, that may go to every task
PAGE_BYTES = 16 << 20
BUCKETS_PER_TASK = 4


def squeezed(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty.

    Single spaces, by far the most frequent runs, are left alone rather than
    replaced by themselves.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _cell(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def doubled(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Depth of the directory and the bucket of each of its cells.

    ``counts`` has the number of keys under each prefix of ``max_depth`` bits.
    A bucket with more than ``capacity`` keys splits on its next bit; the
    directory doubles when that bit is beyond its depth.  A bucket still
    overfull at ``max_depth`` stays so and is only longer to process.
    """
    level = [0] * (1 << max_depth)
    for cell, n in counts.items():
        level[cell] += n
    totals = {max_depth: level}
    for depth in range(max_depth - 1, -1, -1):
        level = [level[2 * i] + level[2 * i + 1] for i in range(1 << depth)]
        totals[depth] = level
    buckets, waiting = [], [(0, 0)]
    while waiting:
        depth, prefix = waiting.pop()
        if totals[depth][prefix] > capacity and depth < max_depth:
            waiting += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        else:
            buckets.append((depth, prefix))
    global_depth = max(depth for depth, _ in buckets)
    cells = [0] * (1 << global_depth)
    ordered = sorted(buckets, key=lambda b: b[1] << (max_depth - b[0]))
    for number, (depth, prefix) in enumerate(ordered):
        width = global_depth - depth
        cells[prefix << width:(prefix + 1) << width] = [number] * (1 << width)
    return global_depth, cells


def build_index(entries: DataFrame) -> DataFrame:
    """Index of ``(doc_id, key, n_bytes)`` rows: ``key, n, pages, bucket``, written by bucket."""
    spark = entries.sparkSession
    chains = written(
        entries.groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("widest")), "dedup-chains")
    counts = {r[0]: r[1] for r in chains.groupBy(_cell(F.col("key"), MAX_DEPTH).alias("cell")).count().collect()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = max(8, sum(counts.values()) // (BUCKETS_PER_TASK * tasks))
    depth, cells = doubled(counts, capacity)
    # at most 2 ** MAX_DEPTH rows, whatever the input
    directory = spark.createDataFrame(list(enumerate(cells)), "cell int, bucket int")
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / PAGE_ROWS), F.ceil(F.col("n") * F.col("widest") / PAGE_BYTES))
    keyed = (chains.withColumn("cell", _cell(F.col("key"), depth))
             .join(F.broadcast(directory), "cell")
             .select("key", "n", F.least("n", pages).cast("int").alias("pages"), "bucket"))
    return written(keyed.repartition("bucket").sortWithinPartitions("bucket", "key"), "dedup-index")


def _chained(batches):
    """Give each row its slot: the place of its text in the chain of its key and page.

    Rows come sorted by key, page and document.  Only the distinct texts of the
    current page are held; they are more than one where keys collide.
    """
    current, chain = None, []
    for batch in batches:
        texts = utf8(batch, "text")
        keys, pages = batch.column("key").to_pylist(), batch.column("page").to_pylist()
        slots, firsts = [], []
        for key, page, text in zip(keys, pages, texts):
            if (key, page) != current:
                current, chain = (key, page), []
            for slot, other in enumerate(chain):
                if other == text:
                    break
            else:
                slot = len(chain)
                chain.append(text)
                firsts.append(True)
                slots.append(slot)
                continue
            firsts.append(False)
            slots.append(slot)
        columns = {name: batch.column(name) for name in batch.schema.names}
        paged = batch.column("pages").to_pylist()
        columns |= {"slot": slots, "first": firsts,
                    "text": [t.decode() if f and p > 1 else None for t, f, p in zip(texts, firsts, paged)]}
        yield columns


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 key: Callable[[Column], Column] = text_key) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared after :func:`squeezed`; null counts as empty, so null and
    empty texts are one group.  The smallest ``doc_id`` of a group stays; a null
    id comes after all others, and of rows that repeat the kept id one stays.
    Columns of ``docs`` other than the two named are not looked at.  An empty
    table gives an empty result.  ``key`` is the hash of the index; a weak one
    only costs time, since bytes decide.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), squeezed(F.col(text)).alias("text"))
    entries = written(source.select(
        "doc_id", key(F.col("text")).alias("key"), F.octet_length("text").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "dedup-entries")
    index = build_index(entries)
    repeated = written(index.filter("n > 1").select("key", "pages", "bucket"), "dedup-repeated")

    alone = entries.join(repeated, "key", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")

    rows = (source.withColumn("key", key(F.col("text"))).join(repeated, "key")
            .withColumn("page", F.pmod(F.xxhash64("doc_id"), F.col("pages")).cast("int"))
            .repartition("bucket", "page")
            .sortWithinPartitions("key", "page", F.asc_nulls_last("doc_id")))
    rows = rows.select("key", "page", "pages", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                       "text")
    chained = written(map_arrow(
        rows, _chained, "key long, page int, pages int, doc_id long, text_sha256 string, slot int, first boolean,"
        " text string"), "dedup-chained")

    place = ["key", "page", "slot"]
    heads = (chained.groupBy(*place).agg(
        F.min("doc_id").alias("head"), F.count("*").alias("n"), F.max("pages").alias("pages"),
        F.max("text").alias("text")))
    single = heads.filter("pages = 1").select(
        *place, F.col("head").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("wins"))
    groups = single.unionByName(_joined_pages(heads.filter("pages > 1")))
    copies = (chained.drop("text", "pages").join(groups, place).select(
        "doc_id", "keep_id", "group_size",
        (F.col("first") & F.col("wins")).alias("kept"), "text_sha256"))
    return alone.unionByName(copies)


def _joined_pages(heads: DataFrame) -> DataFrame:
    """Chains across the pages of one key: the first text of each page, compared again."""
    work = (heads.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("head"), "page", "slot")
            .select("key", F.lit(0).alias("page"), "pages", "text", "head", "n",
                    F.col("page").alias("own_page"), F.col("slot").alias("own_slot")))
    met = map_arrow(work, _chained, "key long, page int, pages int, text string, head long, n long, own_page int,"
                    " own_slot int, slot int, first boolean")
    met = written(met.drop("text", "page", "pages"), "dedup-heads")
    total = met.groupBy("key", "slot").agg(F.sum("n").alias("group_size"), F.min("head").alias("keep_id"))
    return met.join(total, ["key", "slot"]).select(
        "key", F.col("own_page").alias("page"), F.col("own_slot").alias("slot"), "keep_id", "group_size",
        F.col("first").alias("wins"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: all columns of the rows that stay.

    Null and empty texts are copies of each other.  Ids may be null or repeated: a
    row is named by its id and its text.  Columns of any name pass through; an
    empty table stays empty.
    """
    groups = exact_groups(docs)
    gone = written(groups.filter(~F.col("kept")).select(
        "doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")), "dedup-gone")
    names = docs.columns
    digest, gone_id, gone_digest = (unused(docs, n) for n in ("_sha256", "gone_id", "gone_sha256"))
    rows = docs.withColumn(digest, F.sha2(squeezed(F.col("text")).cast("binary"), 256))
    named = [F.col("doc_id").eqNullSafe(F.col(gone_id)), F.col(digest) == F.col(gone_digest)]
    of = lambda df: df.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_digest)).distinct()
    # texts stay where they are while the list of dropped rows is small
    few = gone.count() <= MOST_SENT
    rest = rows.join(F.broadcast(of(gone)) if few else of(gone), named, "left_anti")
    again = gone.filter("again")
    if again.isEmpty():
        return rest.select(*names)
    # a dropped row has id and text of the row that stays: one of those rows is kept
    twice = rows.join(F.broadcast(of(again)) if few else of(again), named, "left_semi").dropDuplicates(["doc_id", digest])
    return rest.unionByName(twice).select(*names)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
