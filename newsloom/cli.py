"""Command line.

    python -m newsloom.cli index   --root DIR --articles DIR [--file F] [--category C] [--retry-failed]
                                   [--dry-run] [--clear-failed] [--stats] [--force] [--asof T]
    python -m newsloom.cli stream  --root DIR --articles DIR [--batch-files N] [--asof T]
    python -m newsloom.cli extract --pages PARQUET --out DIR --day D
    python -m newsloom.cli links   --pages PARQUET --out DIR [--origin URL] [--any-link]
    python -m newsloom.cli backfill --articles DIR --today D [--max-days N] [--origin URL]
    python -m newsloom.cli clean-urls --articles DIR --out DIR [--apply]
    python -m newsloom.cli tool    --root DIR --asof T NAME [key=value ...]
    python -m newsloom.cli search  --root DIR --asof T TEXT [--k N] [--vector]
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession, functions as F

from newsloom import constants as C
from newsloom.config import Settings
from newsloom.functions import urls
from newsloom.functions.providers import WordHistogram
from newsloom.operators import crawl, ledger
from newsloom.operators.lexical import PostingTable
from newsloom.operators.statistics import BatchStats
from newsloom.plans.api import Api
from newsloom.plans.engine import Engine
from newsloom.plans.ingest import Indexer, rewrite_urls, write_articles
from newsloom.session import build_session
from newsloom.sources import articles as A
from newsloom.sources.chunk_table import ChunkTable
from newsloom.sources.file_log import FileLog
from newsloom.streaming.incremental import article_stream, index_stream


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="newsloom", description="News corpus jobs on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    now = datetime.now().strftime("%Y-%m-%d %H:%M:%S")

    index = commands.add_parser("index")
    index.add_argument("--root", required=True)
    index.add_argument("--articles")
    index.add_argument("--file")
    index.add_argument("--category")
    index.add_argument("--asof", default=now)
    for flag in ("--retry-failed", "--dry-run", "--clear-failed", "--stats", "--force"):
        index.add_argument(flag, action="store_true")

    stream = commands.add_parser("stream")
    stream.add_argument("--root", required=True)
    stream.add_argument("--articles", required=True)
    stream.add_argument("--batch-files", type=int, default=5)
    stream.add_argument("--asof", default=now)

    extract = commands.add_parser("extract")
    extract.add_argument("--pages", required=True)
    extract.add_argument("--out", required=True)
    extract.add_argument("--day", required=True)

    links = commands.add_parser("links")
    links.add_argument("--pages", required=True)
    links.add_argument("--out", required=True)
    links.add_argument("--origin", default="")
    links.add_argument("--any-link", action="store_true", help="not only links in <h3>")
    links.add_argument("--known", action="append", default=[], help="table of URLs crawled or skipped before; may be repeated")
    links.add_argument("--home-cap", type=int, default=C.HOME_LINK_CAP)
    links.add_argument("--cap", type=int, default=C.CATEGORY_LINK_CAP)
    links.add_argument("--no-quota", action="store_true", help="all links, however many a category has")

    backfill = commands.add_parser("backfill")
    backfill.add_argument("--articles", required=True)
    backfill.add_argument("--today", default=now[:10])
    backfill.add_argument("--max-days", type=int, default=C.BACKFILL_DAYS)
    backfill.add_argument("--origin", default="")

    clean = commands.add_parser("clean-urls")
    clean.add_argument("--articles", required=True)
    clean.add_argument("--out", required=True)
    clean.add_argument("--apply", action="store_true")

    tool = commands.add_parser("tool")
    tool.add_argument("--root", required=True)
    tool.add_argument("--asof", default=now)
    tool.add_argument("name")
    tool.add_argument("arguments", nargs="*", metavar="key=value")

    search = commands.add_parser("search")
    search.add_argument("--root", required=True)
    search.add_argument("--asof", default=now)
    search.add_argument("text")
    search.add_argument("--k", type=int, default=5)
    search.add_argument("--vector", action="store_true")
    return parser


def _indexer(spark: SparkSession, root: str, settings: Settings) -> Indexer:
    table = ChunkTable(spark, f"{root}/chunks", settings.table_buckets)
    return Indexer(
        spark, table, FileLog(spark, f"{root}/log"), settings.default_source, WordHistogram(settings.vector_dim),
        chunk_tokens=settings.chunk_tokens, overlap_tokens=settings.overlap_tokens,
        index=PostingTable(f"{root}/postings", settings.table_buckets), stats=BatchStats(f"{root}/stats"),
    )


def _stored_index(spark: SparkSession, root: str, settings: Settings) -> PostingTable | None:
    index = PostingTable(f"{root}/postings", settings.table_buckets)
    return index if index.exists(spark) else None


def _index(spark: SparkSession, args, settings: Settings) -> int:
    indexer = _indexer(spark, args.root, settings)
    if args.stats:
        indexer.stats().show(truncate=False)
        indexer.kept_stats.stats(spark).show(truncate=False)
        return 0
    if args.clear_failed:
        print(f"cleared {indexer.clear_failed()} failed entries")
        return 0
    if args.file:
        results = indexer.index_path(args.file, args.asof, args.force)
    elif not args.articles:
        print("--articles or --file is required", file=sys.stderr)
        return 2
    else:
        folder = f"{args.articles}/{args.category}" if args.category else args.articles
        if args.dry_run:
            indexer.dry_run(folder).show(truncate=False)
            return 0
        if args.force:
            results = indexer.index_files(A.read_article_files(spark, folder), args.asof)
        else:
            results = indexer.index_directory(folder, args.asof, args.retry_failed)
    done = ledger.batch_rollup(results).first()
    print(f"indexed {done['indexed']}, failed {done['failed']}, {done['seconds_per_file'] or 0:.2f} s a file")
    return 1 if done["failed"] else 0


def _value(text: str):
    return int(text) if text.lstrip("-").isdigit() else text


def run(spark: SparkSession, argv: list[str]) -> int:
    args, settings = _parser().parse_args(argv), Settings.from_env()
    if args.command == "index":
        return _index(spark, args, settings)
    if args.command == "stream":
        indexer = _indexer(spark, args.root, settings)
        rows = article_stream(spark, args.articles, args.batch_files)
        index_stream(rows, indexer, f"{args.root}/progress", args.asof).awaitTermination()
        indexer.stats().show()
    elif args.command == "extract":
        rows = crawl.extract_articles(spark.read.parquet(args.pages))
        write_articles(rows.drop("page_id").withColumn("day", F.lit(args.day)), args.out)
    elif args.command == "links":
        pages = spark.read.parquet(args.pages)
        found = crawl.page_links(pages, None if args.any_link else "h3", args.origin)
        found = crawl.article_links(found, settings.site_domain)
        for known in args.known:
            found = ledger.new_links(found, spark.read.parquet(known).select(urls.normalize_url(F.col("url")).alias("url")))
        caps = {} if args.no_quota else {"home_cap": args.home_cap, "cap": args.cap}
        listed = pages.select("page_id", crawl.listing_category(F.col("url"), args.origin).alias("category"))
        crawl.link_quota(found.join(listed, "page_id"), **caps).write.mode("errorifexists").parquet(args.out)
    elif args.command == "backfill":
        files = A.read_article_files(spark, args.articles)
        day = F.regexp_extract("path", r"/(?:day=)?(\d{4}-\d{2}-\d{2})/[^/]+$", 1)
        days = files.select(F.nullif(day, F.lit("")).try_cast("date").alias("day"))
        crawl.archive_pages(crawl.missing_days(days, args.today, args.max_days), args.origin).show(truncate=False)
    elif args.command == "clean-urls":
        rewrite_urls(spark, args.articles, args.out, args.apply).show()
    else:
        table = ChunkTable(spark, f"{args.root}/chunks", settings.table_buckets)
        engine = Engine(table.read(), args.asof, WordHistogram(settings.vector_dim),
                        index=_stored_index(spark, args.root, settings))
        if args.command == "tool":
            arguments = {k: _value(v) for k, v in (pair.split("=", 1) for pair in args.arguments)}
            print(engine.tool(args.name, **arguments).first()["report"])
        else:
            Api(engine, table).search(args.text, args.k, not args.vector).select(
                "score", "title", "category", "published_at", urls.normalize_url(F.col("url")).alias("url")
            ).show(args.k, truncate=80)
    return 0


def main() -> int:
    try:
        return run(build_session("newsloom"), sys.argv[1:])
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
