"""Chunk table, file log, article files and streams on small literal inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom import schemas as S
from newsloom.functions import providers
from newsloom.operators import crawl, enrich, ledger, sessions
from newsloom.plans.api import Api, ChatLog, chat, stream_frames
from newsloom.plans.engine import Engine
from newsloom.plans.ingest import Indexer, rewrite_urls, write_articles
from newsloom.sources import article_writer as W, articles as A
from newsloom.sources.chunk_table import ChunkTable
from newsloom.sources.file_log import FileLog
from newsloom.streaming import incremental as I

NOW = "2026-01-24 00:00:00"


def article(n, **changes):
    return {
        "title": f"Title {n}", "url": f"https://example.com/tech/story-{n}?ref=x", "source": None, "category": "tech",
        "content": f"Story {n} begins here. " + "It goes on for a while. " * 8, "author": "A\n  B",
        "published_at": "Updated Jan. 23, 2026 4:39 pm ET", "is_exclusive": n == 1, **changes,
    }


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "articles" / "tech" / "2026-01-23"
    root.mkdir(parents=True)
    for n in (1, 2):
        (root / f"a{n}.json").write_text(json.dumps(article(n), indent=1))
    (root / "bad.json").write_text("{not json")
    (root / "short.json").write_text(json.dumps(article(9, content="x" * 99)))
    (root / "note.txt").write_text("ignored")
    return tmp_path / "articles"


def parts(spark, tmp_path):
    table = ChunkTable(spark, f"{tmp_path}/table", 4)
    return table, Indexer(spark, table, FileLog(spark, f"{tmp_path}/log"))


def test_read_and_validate(spark, folder):
    files = A.read_article_files(spark, str(folder))
    out = {os.path.basename(r["path"]): r["error"] for r in A.validate(files).collect()}
    assert out == {"a1.json": None, "a2.json": None, "bad.json": "Invalid JSON", "short.json": "Content too short (99 chars)"}
    row = A.clean(files, "news").filter("title = 'Title 1'").first()
    assert row["author"] == "A B" and row["source"] == "news" and row["is_exclusive"]
    assert row["url"].endswith("?ref=x") and str(row["published_at"]) == "2026-01-23 16:39:00"
    exact = A.read_article_files(spark, str(folder)).filter("title IS NULL")
    assert exact.count() == 1


def test_index_directory_then_retry(spark, folder, tmp_path):
    table, indexer = parts(spark, tmp_path)
    assert indexer.dry_run(str(folder)).count() == 4
    first = {os.path.basename(r["path"]): r for r in indexer.index_directory(str(folder), NOW).collect()}
    assert first["a1.json"]["outcome"] == "indexed" and first["bad.json"]["error"] == "Invalid JSON"
    assert indexer.stats().first().asDict() == {"indexed_files": 2, "failed_files": 2, "total_chunks": 2}
    assert indexer.pending(str(folder)).count() == 0
    assert indexer.pending(str(folder), include_failed=True).count() == 2
    (folder / "tech" / "2026-01-23" / "short.json").write_text(json.dumps(article(9)))
    indexer.index_directory(str(folder), NOW, include_failed=True)
    assert indexer.stats().first()["indexed_files"] == 3 and indexer.stats().first()["failed_files"] == 1
    assert indexer.clear_failed() == 1
    assert indexer.pending(str(folder)).count() == 1
    assert table.read().count() == 3
    skipped = indexer.index_path(str(folder / "tech" / "2026-01-23" / "a1.json"), NOW)
    assert skipped.count() == 0


def test_same_url_later_file_wins(spark, folder, tmp_path):
    twin = article(2, url="https://example.com/tech/story-1#x", title="Second telling")
    (folder / "tech" / "2026-01-23" / "z.json").write_text(json.dumps(twin))
    table, indexer = parts(spark, tmp_path)
    indexer.index_directory(str(folder), NOW)
    titles = {r["title"] for r in table.read().collect()}
    assert titles == {"Second telling", "Title 2"}


def chunk_rows(spark, article_id, texts, **columns):
    rows = spark.createDataFrame([(article_id, f"{article_id}_{i}", i, t) for i, t in enumerate(texts)],
                                 "article_id string, chunk_id string, chunk_index int, content string")
    for name, value in columns.items():
        rows = rows.withColumn(name, value)
    return rows


def test_upsert_modes_and_delete(spark, tmp_path):
    table = ChunkTable(spark, f"{tmp_path}/t", 4)
    table.upsert(chunk_rows(spark, "a", ["1", "2", "3"]).unionByName(chunk_rows(spark, "b", ["x"])))
    table.upsert(chunk_rows(spark, "a", ["new"]))
    content = lambda: sorted((r["chunk_id"], r["content"]) for r in table.read().collect())
    # a shorter article keeps its old tail in chunk mode ...
    assert content() == [("a_0", "new"), ("a_1", "2"), ("a_2", "3"), ("b_0", "x")]
    table.upsert(chunk_rows(spark, "a", ["only"]), mode="article")
    assert content() == [("a_0", "only"), ("b_0", "x")]  # ... and loses it in article mode
    assert table.delete_article("a") == 1 and table.delete_article("a") == 0
    assert content() == [("b_0", "x")]
    assert table.size().first()["chunks"] == 1
    with pytest.raises(ValueError):
        table.upsert(chunk_rows(spark, "a", ["y"]), mode="other")


def test_readers_keep_their_snapshot(spark, tmp_path):
    table = ChunkTable(spark, f"{tmp_path}/t", 2)
    table.upsert(chunk_rows(spark, "a", ["1"]))
    before = table.read()
    table.upsert(chunk_rows(spark, "a", ["2"]))
    assert before.first()["content"] == "1" and table.read().first()["content"] == "2"
    stale = table._snapshot()
    table.upsert(chunk_rows(spark, "a", ["3"]))
    with pytest.raises(RuntimeError):
        table._publish(stale)


def test_create_drop_and_grow(spark, tmp_path):
    old = StructType([f for f in S.CHUNK.fields if f.name != "subtitle"])
    small = ChunkTable(spark, f"{tmp_path}/t", 2, old)
    assert small.ensure_schema()["status"] == "created" and small.create() == "exists"
    small.upsert(chunk_rows(spark, "a", ["1"]))
    full = ChunkTable(spark, f"{tmp_path}/t", 2)
    assert full.missing_fields() == ["subtitle"]
    assert full.ensure_schema() == {"status": "updated", "fields_added": ["subtitle"]}
    assert full.ensure_schema()["status"] == "current"
    full.upsert(chunk_rows(spark, "b", ["2"], subtitle=F.lit("s")))
    assert {(r["article_id"], r["subtitle"]) for r in full.read().collect()} == {("a", None), ("b", "s")}
    assert full.create(recreate=True) == "created" and full.read().count() == 0
    assert full.drop() and not full.drop() and not full.exists()


def test_log_rules(spark, tmp_path):
    log = FileLog(spark, f"{tmp_path}/log")
    assert log.stats().first()["indexed_files"] == 0
    row = lambda path, outcome: spark.createDataFrame(
        [(path, outcome, "id", 2, None, None)],
        "path string, outcome string, article_id string, chunks long, error string, at timestamp_ntz")
    log.append(row("a", "failed"), 1)
    log.append(row("a", "indexed"), 2)
    assert log.failed().count() == 0  # success clears failure
    log.append(row("a", "failed"), 3)
    assert log.failed().count() == 1 and log.indexed().count() == 1  # failure keeps success


def test_supplied_summary_wins(spark):
    rows = spark.createDataFrame(
        [("i", "t", "u", "One. Two. Three.", "s", None, None, None, False, None, "given"), ("j", "t", "u", "One. Two. Three.", "s", None, None, None, False, None, None)],
        S.ARTICLE)
    out = {r["article_id"]: r for r in enrich.process_articles(rows, F.lit(NOW)).collect()}
    assert out["i"]["article_summary"] == "given" and out["j"]["article_summary"] == "One. Two. Three."
    assert out["i"]["chunk_summary"] == "One. Two."
    bare = enrich.process_articles(rows, F.lit(NOW), summarizer=None).filter("article_id = 'j'").first()
    assert bare["article_summary"] == "" and bare["chunk_summary"] == ""


def test_file_names_collide(spark):
    rows = spark.createDataFrame([(i, "https://x.com/a/same", "c") for i in range(130)], "position long, url string, category string")
    out = {r["path"]: r["position"] for r in crawl.article_files(rows, "2026-01-01").collect()}
    assert len(out) == 130
    assert out["c/2026-01-01/same.json"] == 0 and out["c/2026-01-01/same_129.json"] == 129


def test_missing_days(spark):
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-20",), ("2026-01-23",)], "day string").select(F.col("day").cast("date").alias("day"))
    out = [str(r["day"]) for r in crawl.missing_days(days, "2026-01-24", 4).collect()]
    assert out == ["2026-01-24", "2026-01-22", "2026-01-21"]
    assert crawl.missing_days(days.limit(0), "2026-01-24").count() == 0


def test_rewrite_and_write(spark, folder, tmp_path):
    counts = rewrite_urls(spark, str(folder), f"{tmp_path}/clean", apply=True).first()
    assert counts.asDict() == {"total": 4, "needs_update": 3, "updated": 3, "errors": 1}
    again = rewrite_urls(spark, f"{tmp_path}/clean", f"{tmp_path}/none").first()
    assert again["needs_update"] == 0 and again["updated"] == 0
    rows = A.clean(A.read_article_files(spark, str(folder)), "news").withColumn("day", F.lit("2026-01-24"))
    write_articles(rows, f"{tmp_path}/out")
    assert os.path.isdir(f"{tmp_path}/out/category=tech/day=2026-01-24")


def test_stream_restart_reads_only_new_files(spark, folder, tmp_path):
    table, indexer = parts(spark, tmp_path)
    run = lambda: I.index_stream(I.article_stream(spark, str(folder), 2), indexer, f"{tmp_path}/progress", NOW).awaitTermination()
    run()
    assert indexer.stats().first()["indexed_files"] == 2
    (folder / "tech" / "2026-01-23" / "late.json").write_text(json.dumps(article(5)))
    run()
    assert indexer.stats().first()["indexed_files"] == 3 and table.read().count() == 3
    batches = [r["seq"] for r in indexer.log.read().select("seq").distinct().collect()]
    assert len(batches) == 3  # two batches of two files, then the late one


def test_url_ledger_across_runs(spark, tmp_path):
    write = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string").write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: I.url_ledger_stream(
        I.table_stream(spark, f"{tmp_path}/in", StructType.fromDDL("url string")), f"{tmp_path}/ledger", f"{tmp_path}/p").awaitTermination()
    write(["https://h/a/b?x=1", "https://h/a/b", "https://h/a/c"])
    run()
    write(["https://h/a/c/", "https://h/a/d"])
    run()
    seen = sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/ledger").collect())
    assert seen == ["https://h/a/b", "https://h/a/c", "https://h/a/d"]


def test_url_ledger_batches_do_not_read_the_ledger(spark, tmp_path):
    """Rows a batch reads are its own whatever the ledger holds; URLs are kept once, in the state."""
    for k in range(4):
        rows = spark.range(100 * k, 100 * k + 200).select(F.concat(F.lit("https://h/"), "id", F.lit("?q")).alias("url"))
        rows = rows.unionAll(spark.range(5000).select(F.lit("https://hot/").alias("url"))).unionAll(rows.limit(1).select(F.lit(None).cast("string")))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = I.table_stream(spark, f"{tmp_path}/in", StructType.fromDDL("url string"), files_per_batch=1)
    query = I.url_ledger_stream(stream, f"{tmp_path}/ledger", f"{tmp_path}/p")
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [5201] * 4
    state = [p["stateOperators"][0] for p in batches]
    assert [s["numRowsTotal"] for s in state] == [201, 301, 401, 501]
    assert all("rocksdbGetCount" in s["customMetrics"] for s in state)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 501


def test_article_files_by_path_over_runs(spark, tmp_path):
    root = str(tmp_path / "articles")
    def run(*rows):
        frame = spark.createDataFrame(list(rows), "position long, category string, url string, title string")
        named = crawl.article_files(frame, "2024-01-31", W.stored_paths(spark, root)).select("path", "url", "title", "category")
        W.write_article_files(named, root)
    run((1, "tech", "https://h/a", "one"), (2, "tech", "https://h/x/a", "two"), (3, None, "https://h/a", None))
    run((1, "tech", "https://h/y/a", "three"), (2, "tech", "https://h/b", "été"))
    run((1, "tech", "https://h/a_1", "named like a number"), (2, "tech", "https://h/z/a", "four"))
    found = {str(p.relative_to(root)): json.loads(p.read_text()) for p in (tmp_path / "articles").rglob("*.json")}
    folder = "tech/2024-01-31"
    assert {k: v.get("title") for k, v in found.items()} == {
        f"{folder}/a.json": "one", f"{folder}/a_1.json": "two", f"{folder}/a_2.json": "three", f"{folder}/a_3.json": "four",
        f"{folder}/b.json": "été", f"{folder}/a_1_1.json": "named like a number", "uncategorized/2024-01-31/a.json": None}
    assert "title" not in found["uncategorized/2024-01-31/a.json"] and not list((tmp_path / "articles").rglob("*.part"))
    assert (tmp_path / "articles" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="outside of the folder"):
        W.write_article_files(spark.createDataFrame([("../out.json", "t")], "path string, title string"), root)
    with pytest.raises(ValueError, match="mounted"):
        W.local_root("s3a://bucket/x")


def test_session_gap_is_inclusive(spark):
    rows = spark.createDataFrame(
        [(1, "2026-01-01 10:00:00"), (1, "2026-01-01 10:30:00"), (1, "2026-01-01 11:00:01")], "k int, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = sorted(r["events"] for r in sessions.activity_sessions(rows, "k").collect())
    assert out == [1, 2]
    last = rows.agg(F.max("ts").alias("t"))
    idle = lambda asof: last.select(sessions.is_expired(F.col("t"), asof).alias("e")).first()["e"]
    assert not idle("2026-01-01 11:30:01") and idle("2026-01-01 11:30:02")


def test_visible_deltas_rules(spark):
    runs = {
        "chat": [("delta", "a"), ("delta", "b"), ("output", "")],
        "tool": [("delta", "junk"), ("tool_call", ""), ("delta", "hidden"), ("tool_result", ""), ("delta", "shown"), ("output", "")],
        "direct": [("tool_call", ""), ("tool_result!", ""), ("delta", "skipped"), ("output", "")],
        "cut": [("delta", "lost")],
    }
    rows = [(run, i, kind.rstrip("!"), kind.endswith("!"), text) for run, events in runs.items() for i, (kind, text) in enumerate(events)]
    df = spark.createDataFrame(rows, "run_id string, seq long, kind string, direct boolean, content string")
    for block in (1, 2, 4096):
        out = sorted((r["run_id"], r["content"]) for r in sessions.visible_deltas(df, block).collect())
        assert out == [("chat", "a"), ("chat", "b"), ("tool", "shown")]


def test_chat_and_api(spark, folder, tmp_path):
    from datetime import datetime

    table, indexer = parts(spark, tmp_path)
    indexer.index_directory(str(folder), NOW)
    engine = Engine(table.read(), NOW)
    log = ChatLog(spark, f"{tmp_path}/chat")
    answer = chat(engine, log, "story begins", datetime(2026, 1, 23, 12, 0))
    assert answer["response"].startswith("Found 2 relevant articles")
    session = answer["session_id"]
    assert log.is_live(session, "2026-01-23 12:30:00") and not log.is_live(session, "2026-01-23 12:30:01")
    log.add_feedback(session, "unknown message", 5, "fine", datetime(2026, 1, 23, 12, 1))
    with pytest.raises(ValueError):
        log.add_feedback(session, "m", 6, None, datetime(2026, 1, 23))
    with pytest.raises(ValueError):
        log.add_message(session, "user", "  ", datetime(2026, 1, 23))
    prompt = log.system_prompt(session, "2026-01-23 12:02:00")
    assert "用户: story begins" in prompt and "- Rating: 5/5 — fine" in prompt and "星期五" in prompt
    assert log.delete_session(session) and not log.is_live(session, "2026-01-23 12:01:00")
    assert not log.delete_session("nobody")
    frames = list(stream_frames(spark, "x" * 21))
    assert frames == ['data: {"type":"delta","content":"%s"}\n\n' % ("x" * 20), 'data: {"type":"delta","content":"x\\n"}\n\n']
    api = Api(engine, table)
    assert {r["service"] for r in api.health().collect()} == {"search", "embedding", "summaries"}
    assert api.add_articles([article(7)], NOW)["written"] == 1
    fresh = Api(Engine(table.read(), NOW), table)
    assert fresh.search("story 7", 2, use_hybrid=False).count() == 2
    assert fresh.search("story", 9).count() == 3  # chunk rows, not cut to articles
    assert fresh.recent(24).count() == 3
    assert fresh.stats().first()["total_chunks"] == 3


def test_daily_tool_uses_generator(spark, folder, tmp_path):
    table, indexer = parts(spark, tmp_path)
    indexer.index_directory(str(folder), NOW)
    engine = Engine(table.read(), NOW, generate=lambda prompt: f"<{prompt.count('「')}>")
    report = engine.tool("daily_briefing", target_date="yesterday").first()["report"]
    assert report.startswith("# 每日新闻总结 — 2026年1月23日（星期五）") and "## 科技\n<2>" in report
    plain = Engine(table.read(), NOW)
    assert "日期格式错误" in plain.tool("daily_briefing", target_date="2026-1-2x").first()["report"]
    assert "No news articles found in the last 1 hours" in plain.tool("trend_analysis", hours=0).first()["report"]
    assert plain.tool("compare_articles", topics="one").first()["report"].startswith("Error")
    with pytest.raises(KeyError):
        plain.tool("nothing")
    assert isinstance(providers.embed_text("a b"), list)


def test_retry_keeps_the_strictly_better(spark, folder, tmp_path):
    table, indexer = parts(spark, tmp_path)
    indexer.index_directory(str(folder), NOW)
    calls = []

    class Scripted(Engine):
        scores = iter([2, 2, 1, 4])

        def evaluate(self, query, results):
            return next(self.scores)

        def execute(self, intent, k):
            calls.append(intent.mode)
            return super().execute(intent, k)

    engine = Scripted(table.read(), NOW)
    assert engine.news_query("story", 2).first()["mode"] == "hybrid"  # a tie keeps the first
    assert engine.news_query("story", 2).first()["mode"] == "semantic"
    assert calls == ["hybrid", "semantic"] * 2


def test_ledger_sets(spark):
    links = spark.createDataFrame([("https://h/a/b?x",), ("https://h/a/c",)], "url string")
    crawled = spark.createDataFrame([("https://h/a/b",)], "url string")
    assert [r["url"] for r in ledger.new_links(links, crawled).collect()] == ["https://h/a/c"]


def test_listing_repeats_a_url(spark):
    scraped = spark.createDataFrame([("u", "", False), ("v", "own", False)], "url string, title string, is_exclusive boolean")
    links = spark.createDataFrame([("u", "b", True), ("u", "a", False)], "clean_url string, title string, is_exclusive boolean")
    out = {r["url"]: tuple(r) for r in crawl.merge_listing(scraped, links).collect()}
    assert len(out) == 2 and out["u"] == ("u", "a", True) and out["v"] == ("v", "own", False)


def test_delete_from_a_missing_table(spark, tmp_path):
    assert ChunkTable(spark, f"{tmp_path}/none").delete_article("a") == 0


def test_repeated_keys_need_an_order(spark, tmp_path):
    rows = chunk_rows(spark, "a", ["1"]).unionByName(chunk_rows(spark, "a", ["2"]))
    with pytest.raises(ValueError):
        ChunkTable(spark, f"{tmp_path}/t", 4).upsert(rows)


def test_two_payloads_of_one_url(spark, tmp_path):
    from newsloom.plans.api import Api
    from newsloom.plans.engine import Engine

    table = ChunkTable(spark, f"{tmp_path}/t", 4)
    table.create()
    payload = lambda text: {"title": "t", "url": "https://x.com/a", "content": text * 30}
    done = Api(Engine(table.read(), NOW), table).add_articles([payload("first "), payload("second ")], NOW)
    rows = table.read().collect()
    assert done["written"] == len(rows) == 1 and rows[0]["content"].startswith("second")


def test_stream_success_clears_a_batch_failure(spark, folder, tmp_path):
    table, indexer = parts(spark, tmp_path)
    name = "tech/2026-01-23/again.json"
    (folder / name).write_text("{")
    indexer.index_directory(str(folder), NOW) if hasattr(indexer, "index_directory") else indexer.index_files(
        A.read_article_files(spark, str(folder)), NOW)
    before = {r["path"] for r in indexer.log.failed().collect()}
    assert any(p.endswith("again.json") for p in before)
    (folder / name).write_text(json.dumps(article(9)))
    I.index_stream(I.article_stream(spark, str(folder), 5), indexer, f"{tmp_path}/progress", NOW).awaitTermination()
    assert not any(r["path"].endswith("again.json") for r in indexer.log.failed().collect())


def test_unreadable_log_is_not_an_empty_log(spark, tmp_path):
    from newsloom.sources.file_log import FileLog

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_text("no parquet")
    assert FileLog(spark, f"{tmp_path}/none").read().count() == 0
    with pytest.raises(Exception):
        FileLog(spark, f"{tmp_path}/log").indexed().collect()


def test_sessions_of_shuffled_micro_batches(spark, tmp_path):
    from newsloom.operators.sessions import activity_sessions

    minutes = [200, 0, 100, 20, 45, 230, 110, 300, 10]
    events = spark.createDataFrame([("u", m) for m in minutes], "user string, m int").select(
        "user", F.timestamp_add("MINUTE", F.col("m"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("ts"))
    for k, row in enumerate(events.collect()):
        spark.createDataFrame([row], events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = I.table_stream(spark, f"{tmp_path}/in", events.schema, files_per_batch=1)
    I.session_stream(stream, "user", f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = I.merged_sessions(spark.read.parquet(f"{tmp_path}/out").drop("batch"), "user")
    want = activity_sessions(events, "user")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    table = ChunkTable(spark, f"{tmp_path}/t", 4)
    table.upsert(chunk_rows(spark, "a", ["1", "2"]).unionByName(chunk_rows(spark, "b", ["x"])))
    table.compact()
    table.vacuum()
    before = set(os.listdir(f"{tmp_path}/t/rows"))
    table.upsert(chunk_rows(spark, "a", ["new"]))
    assert set(os.listdir(f"{tmp_path}/t/rows")) == before
    [delta] = table._snapshot()["deltas"]
    delta = f"commit={delta}"
    assert spark.read.parquet(f"{tmp_path}/t/deltas/{delta}").count() == 1
    assert sorted(r["content"] for r in table.read().collect()) == ["2", "new", "x"]


def test_deltas_fold_compact_and_vacuum(spark, tmp_path, monkeypatch):
    from newsloom.sources import chunk_table

    monkeypatch.setattr(chunk_table, "MAX_DELTAS", 3)
    table = ChunkTable(spark, f"{tmp_path}/t", 4)
    table.upsert(chunk_rows(spark, "a", ["1", "2"]).unionByName(chunk_rows(spark, "b", ["x", "y"])))
    table.compact()
    table.upsert(chunk_rows(spark, "a", ["a1"]))
    table.upsert(chunk_rows(spark, "b", ["b1"]), mode="article")
    assert table.delete_article("a") == 2
    assert len(table._snapshot()["deltas"]) == 1
    table.upsert(chunk_rows(spark, "a", ["again"]))
    state = lambda: sorted((r["article_id"], r["content"]) for r in table.read().collect())
    assert state() == [("a", "again"), ("b", "b1")]
    table.compact()
    assert state() == [("a", "again"), ("b", "b1")] and table._snapshot()["deltas"] == []
    assert table.vacuum() > 0 and state() == [("a", "again"), ("b", "b1")]
    assert os.listdir(f"{tmp_path}/t/deltas") == [] and len(os.listdir(f"{tmp_path}/t/rows")) == 1
    assert table.size().first()["chunks"] == 2


def test_a_table_in_a_folder_streams_like_one_in_a_file(spark, tmp_path):
    from newsloom.catalog import streams

    rows = spark.createDataFrame([(c, t, "user", "x") for c in range(6) for t in range(c + 1)], "conv_id long, turn long, role string, text string")
    rows.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")  # more files than a micro-batch takes
    got = {tuple(r) for r in streams.stream_history(spark, str(tmp_path)).select("session_id", "kept", "oldest_seq", "newest_seq").collect()}
    assert got == {(str(c), min(c + 1, 4), max(c - 3, 0), c) for c in range(6)}
