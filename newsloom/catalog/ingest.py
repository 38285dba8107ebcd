"""Queries of the ledgers and the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query, sql as Q
from newsloom.functions import urls
from newsloom.operators import enrich, ledger
from newsloom.plans.ingest import Indexer
from newsloom.session import scratch_path
from newsloom.sources import articles as A, fixtures as X
from newsloom.sources.article_writer import local_root, write_article_files
from newsloom.sources.chunk_table import ChunkTable
from newsloom.sources.file_log import FileLog

# documents as files: labelled ones are indexed, unlabelled French ones failed
_LEDGER = """
files AS (SELECT 'articles/' || source || '/' || doc_id || '.json' AS path, doc_id, lang, n_chars FROM documents),
indexed AS (SELECT path, n_chars // 2048 + 1 AS chunks FROM files WHERE doc_id IN (SELECT doc_id FROM labels)),
failed AS (SELECT path FROM files WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels))"""


def _ledger(spark, sf):
    docs = X.table(spark, sf, "documents")
    path = F.concat(F.lit("articles/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json"))
    files = docs.select(path.alias("path"), "doc_id", "lang", "n_chars")
    labelled = X.table(spark, sf, "labels").select("doc_id")
    indexed = files.join(labelled, "doc_id", "left_semi").select(
        "path", F.md5("path").alias("article_id"), (F.floor(F.col("n_chars") / 2048) + 1).alias("chunks"),
        F.lit(X.ASOF).cast("timestamp_ntz").alias("indexed_at"),
    )
    failed = files.filter(F.col("lang") == "fr").join(labelled, "doc_id", "left_anti").select(
        "path", F.lit("timeout").alias("error"), F.lit(X.ASOF).cast("timestamp_ntz").alias("failed_at")
    )
    return files, indexed, failed


@query("path_normalize", """SELECT doc_id, 'news/' || source || '/' || doc_id || '.json' AS path FROM documents""")
def path_normalize(spark, sf):
    """Paths as another system writes them."""
    path = F.concat_ws("\\", F.lit("news"), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".json")))
    return X.table(spark, sf, "documents").select("doc_id", urls.unix_path(path).alias("path"))


@query("pending_files", f"""
WITH {_LEDGER} SELECT path FROM files WHERE path NOT IN (SELECT path FROM indexed) AND path NOT IN (SELECT path FROM failed)""")
def pending_files(spark, sf):
    files, indexed, failed = _ledger(spark, sf)
    return ledger.pending(files, indexed, failed).select("path")


@query("pending_with_failed", f"WITH {_LEDGER} SELECT path FROM files WHERE path NOT IN (SELECT path FROM indexed)")
def pending_with_failed(spark, sf):
    files, indexed, failed = _ledger(spark, sf)
    return ledger.pending(files, indexed, failed, include_failed=True).select("path")


@query("ledger_stats", f"""
WITH {_LEDGER} SELECT (SELECT count(*) FROM indexed) AS indexed_files, (SELECT count(*) FROM failed) AS failed_files,
  (SELECT sum(chunks)::BIGINT FROM indexed) AS total_chunks""")
def ledger_stats(spark, sf):
    _, indexed, failed = _ledger(spark, sf)
    return ledger.ledger_stats(indexed, failed)


# a second batch: half of the failed files work now, some indexed ones break
@query("ledger_update", f"""
WITH {_LEDGER}, done AS (SELECT f.path FROM failed f JOIN files USING (path) WHERE n_chars > 1500),
broken AS (SELECT i.path FROM indexed i JOIN files USING (path) WHERE n_chars < 500)
SELECT path, 'indexed' AS state FROM (SELECT path FROM indexed UNION SELECT path FROM done)
UNION ALL SELECT path, 'failed' FROM (SELECT path FROM failed WHERE path NOT IN (SELECT path FROM done) UNION SELECT path FROM broken)""")
def ledger_update(spark, sf):
    files, indexed, failed = _ledger(spark, sf)
    sizes = files.select("path", "n_chars")
    done = failed.join(sizes, "path").filter("n_chars > 1500").select(
        "path", F.md5("path").alias("article_id"), F.lit(1).cast("long").alias("chunks"), F.col("failed_at").alias("indexed_at")
    )
    broken = indexed.join(sizes, "path").filter("n_chars < 500").select(
        "path", F.lit("broken").alias("error"), F.col("indexed_at").alias("failed_at")
    )
    new_indexed, new_failed = ledger.record(indexed, failed, done, broken)
    return new_indexed.select("path", F.lit("indexed").alias("state")).unionByName(
        new_failed.select("path", F.lit("failed").alias("state"))
    )


@query("file_log_state", f"""
WITH {_LEDGER}, again AS (SELECT f.path FROM failed f JOIN files USING (path) WHERE n_chars > 1500)
SELECT (SELECT count(*) FROM indexed) + (SELECT count(*) FROM again) AS indexed_files,
  (SELECT count(*) FROM failed) - (SELECT count(*) FROM again) AS failed_files,
  ((SELECT sum(chunks) FROM indexed) + (SELECT count(*) FROM again))::BIGINT AS total_chunks""")
def file_log_state(spark, sf):
    files, indexed, failed = _ledger(spark, sf)
    log = FileLog(spark, scratch_path(spark, "log"))
    row = lambda df, outcome, chunks, error: df.select(
        "path", F.lit(outcome).alias("outcome"), F.md5("path").alias("article_id"), chunks.cast("long").alias("chunks"),
        error.cast("string").alias("error"), F.lit(X.ASOF).cast("timestamp_ntz").alias("at"),
    )
    log.append(row(indexed, "indexed", F.col("chunks"), F.lit(None)), 1)
    log.append(row(failed, "failed", F.lit(0), F.col("error")), 1)
    again = failed.join(files.filter("n_chars > 1500"), "path", "left_semi")
    log.append(row(again, "indexed", F.lit(1), F.lit(None)), 2)
    return log.stats()


@query("batch_rollup", """
SELECT event_type AS directory, count(*) AS total_files, count(*) FILTER (value < 30) AS indexed,
  count(*) FILTER (value >= 30 AND value < 60) AS skipped, count(*) FILTER (value >= 60) AS failed,
  coalesce(sum(user_id) FILTER (value < 30), 0)::BIGINT AS total_chunks, round(avg(user_id), 6) AS seconds_per_file FROM events GROUP BY event_type
UNION ALL SELECT NULL, count(*), count(*) FILTER (value < 30), count(*) FILTER (value >= 30 AND value < 60),
  count(*) FILTER (value >= 60), coalesce(sum(user_id) FILTER (value < 30), 0)::BIGINT, round(avg(user_id), 6) FROM events""")
def batch_rollup(spark, sf):
    value = F.col("value")
    results = X.table(spark, sf, "events").select(
        F.col("event_type").alias("directory"), F.col("user_id").alias("chunks"), F.col("user_id").alias("seconds"),
        F.when(value < 30, "indexed").when(value < 60, "skipped").otherwise("failed").alias("outcome"),
    )
    totals = ledger.batch_rollup(results).withColumn("directory", F.lit(None).cast("string"))
    rows = ledger.batch_rollup(results, "directory").unionByName(totals)
    return rows.withColumn("seconds_per_file", F.round("seconds_per_file", 6))


# rewrite of the exclusive articles' chunks with a smaller chunk size: in chunk
# mode a shorter article would keep its old tail, here articles get longer
_FRESH = f"""
lists AS (SELECT * EXCLUDE (f), list_concat(f.done, CASE WHEN len(f.cur) > 0 THEN [array_to_string(f.cur, ' ')] ELSE []::VARCHAR[] END) AS again
  FROM (SELECT *, {Q.packed(Q.sentences('content'), 4096, 200)} AS f FROM articles WHERE is_exclusive)),
fresh AS (SELECT article_id, article_id || '_' || (i - 1) AS chunk_id, again[i] AS content FROM (SELECT *, unnest(range(1, len(again) + 1)) AS i FROM lists))"""


def _changed_table(spark, sf, mode):
    store = ChunkTable(spark, scratch_path(spark, f"upsert-{mode}"), 8)
    store.replace_all(X.corpus(spark, sf))
    changed = X.articles(spark, sf).filter("is_exclusive")
    fresh = enrich.process_articles(changed, F.lit(X.CRAWLED_AT), summarizer=None, chunk_tokens=1024)
    store.upsert(fresh, mode)
    return store


@query("upsert_chunks", f"""
WITH {Q.CHUNKS}, {_FRESH}
SELECT chunk_id, md5(content) AS digest FROM fresh
UNION ALL SELECT chunk_id, md5(content) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh)""")
def upsert_chunks(spark, sf):
    return _changed_table(spark, sf, "chunk").read().select("chunk_id", F.md5("content").alias("digest"))


@query("upsert_articles", f"""
WITH {Q.CHUNKS}, {_FRESH}
SELECT chunk_id, md5(content) AS digest FROM fresh
UNION ALL SELECT chunk_id, md5(content) FROM chunks WHERE article_id NOT IN (SELECT article_id FROM fresh)""")
def upsert_articles(spark, sf):
    return _changed_table(spark, sf, "article").read().select("chunk_id", F.md5("content").alias("digest"))


@query("delete_article", f"""
WITH {Q.CHUNKS}, longest AS (SELECT article_id FROM chunks GROUP BY article_id ORDER BY count(*) DESC, article_id LIMIT 1)
SELECT category, count(*) AS chunks FROM chunks WHERE article_id NOT IN (SELECT article_id FROM longest) GROUP BY category""")
def delete_article(spark, sf):
    store = ChunkTable(spark, scratch_path(spark, "delete"), 8)
    store.replace_all(X.corpus(spark, sf))
    rows = store.read()
    longest = rows.groupBy("article_id").count().orderBy(F.col("count").desc(), "article_id").first()["article_id"]
    store.delete_article(longest)
    return store.read().groupBy("category").agg(F.count("*").alias("chunks"))


@query("table_size", f"WITH {Q.CHUNKS} SELECT count(*) AS chunks, true AS has_files, true AS has_bytes FROM chunks")
def table_size(spark, sf):
    size = ChunkTable(spark, X.corpus_root(spark, sf)).size()
    return size.select("chunks", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > F.col("files")).alias("has_bytes"))


@query("add_articles_last_wins", """
SELECT md5('https://example.com/' || doc_id % 40) AS article_id, max_by('title ' || doc_id, doc_id) AS title, 1::BIGINT AS rows
FROM documents WHERE length(regexp_replace("text", '^\\s+|\\s+$', '', 'g')) >= 100 GROUP BY 1""")
def add_articles_last_wins(spark, sf):
    """Articles written twice under one URL: the later one stays, in one row for each chunk."""
    docs = X.table(spark, sf, "documents").filter(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= 100)
    rows = docs.select(
        F.md5(F.concat(F.lit("https://example.com/"), F.col("doc_id") % 40)).alias("article_id"), F.lit(0).alias("chunk_index"),
        F.concat(F.lit("title "), F.col("doc_id")).alias("title"), "doc_id",
    ).withColumn("chunk_id", F.concat("article_id", F.lit("_0")))
    store = ChunkTable(spark, scratch_path(spark, "last-wins"), 8)
    store.upsert(rows, order="doc_id")
    return store.read().groupBy("article_id").agg(F.max("title").alias("title"), F.count("*").alias("rows"))


@query("schema_evolution", f"WITH {Q.CHUNKS} SELECT count(*) AS chunks, count(*) AS empty_new_columns, 2 AS fields_added FROM chunks")
def schema_evolution(spark, sf):
    from pyspark.sql.types import StructType
    from newsloom import schemas as S

    old = StructType([f for f in S.CHUNK.fields if f.name not in ("subtitle", "crawled_at")])
    root = scratch_path(spark, "schema")
    store = ChunkTable(spark, root, 4, old)
    store.replace_all(X.corpus(spark, sf))
    grown = ChunkTable(spark, root, 4)
    change = grown.ensure_schema()
    return grown.read().agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("subtitle").isNull() & F.col("crawled_at").isNull()).alias("empty_new_columns"),
    ).withColumn("fields_added", F.lit(len(change["fields_added"])))


def _record_files(spark, sf):
    """Folder with a JSON file for each document, below a folder for each source."""
    root = f"{scratch_path(spark, 'records')}/articles"
    docs = X.table(spark, sf, "documents")
    write_article_files(docs.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".json")).alias("path"),
        F.concat(F.lit("title "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), F.col("source").alias("category"),
        F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("/?x")).alias("url"),
    ), root)
    return root


def _below(root):
    return F.substring_index("path", f"{local_root(root)}/", -1).alias("path")


@query("article_scan", """
SELECT source || '/' || doc_id || '.json' AS path, 'title ' || doc_id AS title, source AS category, md5("text") AS digest,
  NULL::VARCHAR AS read_error FROM documents""")
def article_scan(spark, sf):
    """A folder of article files and its folders, read back."""
    root = _record_files(spark, sf)
    files = A.read_article_files(spark, root)
    return files.select(_below(root), "title", "category", F.md5("content").alias("digest"), "read_error")


@query("dry_run_files", """
SELECT source || '/' || doc_id || '.json' AS path FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 20""")
def dry_run_files(spark, sf):
    """The first twenty files to index, where the labelled documents are indexed already."""
    root = _record_files(spark, sf)
    labelled = X.table(spark, sf, "labels").select("doc_id").distinct()
    done = X.table(spark, sf, "documents").join(labelled, "doc_id", "left_semi").select(
        F.concat(F.lit(f"{local_root(root)}/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".json")).alias("path"),
        F.lit("indexed").alias("outcome"), F.lit(None).cast("string").alias("article_id"), F.lit(1).cast("long").alias("chunks"),
        F.lit(None).cast("string").alias("error"), F.lit(X.ASOF).cast("timestamp_ntz").alias("at"))
    log = FileLog(spark, scratch_path(spark, "log"))
    log.append(done, 1)
    indexer = Indexer(spark, ChunkTable(spark, scratch_path(spark, "chunks"), 8), log)
    return indexer.dry_run(root).select(_below(root))


@query("request_payloads", f"""
SELECT doc_id AS payload, md5('https://example.com/' || source || '/' || doc_id) AS article_id, source AS category,
  md5({Q.strip('"text"')}) AS digest FROM documents WHERE length({Q.strip('"text"')}) >= 100""")
def request_payloads(spark, sf):
    """``documents`` as the bodies of requests."""
    docs = X.table(spark, sf, "documents")
    body = F.to_json(F.struct(
        F.concat(F.lit("title "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), F.col("source").alias("category"),
        F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("/?x")).alias("url")))
    rows = A.request_rows(docs.select(F.col("doc_id").alias("payload"), body.alias("body")), "news")
    return rows.select("payload", "article_id", "category", F.md5("content").alias("digest"))
