"""Searches from stored indexes: upkeep, pruning and cells against plain scans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.catalog import retrieval
from newsloom.functions.providers import WordHistogram, embedding
from newsloom.operators.cells import VectorCells
from newsloom.operators.hybrid import Query, hybrid_batch, hybrid_hits
from newsloom.operators.lexical import PostingTable
from newsloom.plans.api import Api
from newsloom.plans.engine import Engine
from newsloom.plans.ingest import Indexer, put_chunks, remove_article
from newsloom.sources import fixtures as X
from newsloom.sources.chunk_table import ChunkTable
from newsloom.sources.file_log import FileLog

NOW = "2026-01-24 00:00:00"


# --- posting table ------------------------------------------------------------------------

def texts(spark, rows):
    return spark.createDataFrame([(i, i, t) for i, t in rows.items()], "article_id string, chunk_id string, content string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")


def hits(frame):
    return {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in frame.collect()}


BOOSTS = {"content": 1.0}


def test_batches_add_up_to_a_fresh_build(spark, tmp_path):
    rows = {f"c{i}": f"apple pear {'plum ' * (i % 4)} number{i % 5} {'filler ' * (i % 7)}" for i in range(40)}
    index = PostingTable(str(tmp_path / "kept"), 4).build(texts(spark, rows), ["content"])
    questions = asked(spark, "apple plum", "number3 cherry", "nothing there", "", "plum plum pear")
    change = {"c1": "cherry cherry plum", "c2": "", "new": "cherry apple number3"}
    gone = {i: rows.pop(i) for i in ("c1", "c2")}
    rows.update(change)
    index.change("v1", texts(spark, change), texts(spark, gone))
    index.change("v1", texts(spark, change), texts(spark, gone))  # written again, not added again
    index.change("v2", removed=texts(spark, {"c7": rows.pop("c7")}))
    fresh = PostingTable(str(tmp_path / "fresh"), 4).build(texts(spark, rows), ["content"])
    assert hits(index.scores(questions, BOOSTS)) == hits(fresh.scores(questions, BOOSTS))
    for k in (1, 3, 100):
        assert hits(index.search(questions, k, BOOSTS)) == hits(fresh.search(questions, k, BOOSTS))
    before = index.at("base").scores(questions, BOOSTS)
    assert (1, "new") not in hits(before) and (0, "c7") in hits(before)


def test_search_follows_every_write(spark, tmp_path):
    table, index = ChunkTable(spark, str(tmp_path / "t"), 4), PostingTable(str(tmp_path / "p"), 4)
    indexer = Indexer(spark, table, FileLog(spark, str(tmp_path / "log")), embedder=WordHistogram(), index=index)

    def write(n, word):
        path = tmp_path / "articles" / f"a{n}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps({"title": f"Title {n}", "url": f"https://example.com/a/{n}", "content": f"Here is {word}. " * 12}))

    def found(word):
        return {r["article_id"] for r in index.scores(asked(spark, word)).collect()}

    write(1, "zebra"), write(2, "gnu")
    indexer.index_directory(str(tmp_path / "articles"), NOW)
    first = found("zebra")
    assert len(first) == 1 and len(found("gnu")) == 1 and first != found("gnu")
    write(3, "zebra")
    indexer.index_directory(str(tmp_path / "articles"), NOW)
    assert len(found("zebra")) == 2 and first < found("zebra")
    write(1, "okapi")
    indexer.index_path(str(tmp_path / "articles" / "a1.json"), NOW, force=True)
    assert found("okapi") == first and len(found("zebra")) == 1
    Api(Engine(table.read(), NOW, index=index), table).add_articles(
        [{"title": "T", "url": "https://example.com/a/9", "content": "An ibex was seen. " * 12}], NOW)
    assert len(found("ibex")) == 1
    assert remove_article(table, first.copy().pop(), index) and found("okapi") == set()
    assert {r["article_id"] for r in index.scores(asked(spark, "here seen")).collect()} == {
        r["article_id"] for r in table.read().select("article_id").distinct().collect()}


def test_whole_articles_are_replaced_in_the_index(spark, tmp_path):
    table, index = ChunkTable(spark, str(tmp_path / "t"), 4), PostingTable(str(tmp_path / "p"), 4)

    def chunks(*rows):
        return spark.createDataFrame([(a, f"{a}_{i}", t) for a, i, t in rows], "article_id string, chunk_id string, content string")

    put_chunks(table, chunks(("x", 0, "red"), ("x", 1, "red"), ("y", 0, "red")), index=index)
    put_chunks(table, chunks(("x", 0, "blue")), mode="article", index=index)
    assert {c for _, c in hits(index.scores(asked(spark, "red"), BOOSTS))} == {"y_0"}
    put_chunks(table, chunks(("y", 0, "blue"), ("y", 1, "red")), index=index)
    assert {c for _, c in hits(index.scores(asked(spark, "red"), BOOSTS))} == {"y_1"}
    assert {c for _, c in hits(index.scores(asked(spark, "blue"), BOOSTS))} == {"x_0", "y_0"}


def test_pruned_search_equals_the_full_one_and_keeps_few_pairs(spark):
    sf = "/root/testdata/sf0.01"
    index, questions = retrieval.posting_table(spark, sf), retrieval._asked(spark, sf)
    full = index.scores(questions, BOOSTS)
    found = index.candidates(questions, 5, BOOSTS)
    pairs, kept, rows = full.count(), found.kept.count(), found.rows.count()
    assert rows == kept and kept < pairs / 10
    order = lambda r: (-round(r["score"], 9), r["chunk_id"])
    wanted = {}
    for r in full.collect():
        wanted.setdefault(r["query_id"], []).append(r)
    got = index.search(questions, 5, BOOSTS).collect()
    for q, all_of in wanted.items():
        best = sorted(all_of, key=order)[:5]
        assert [r["chunk_id"] for r in sorted((g for g in got if g["query_id"] == q), key=order)] == [r["chunk_id"] for r in best]


# --- vectors in cells --------------------------------------------------------------------

def brute(vectors, probes, k):
    out = {}
    for q, probe in probes.items():
        scores = []
        for i, v in vectors.items():
            if v is None or probe is None or len(v) != len(probe):
                continue
            a, b = np.asarray(v, np.float32).astype(float), np.asarray(probe)
            size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            scores.append((-round((1 + ((a * b).sum() / size if size else 0.0)) / 2, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: rows for q, rows in out.items() if rows}


@pytest.mark.parametrize("k", [1, 4, 500])
def test_cells_find_the_nearest(spark, tmp_path, k):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(6, 8))
    vectors = {f"v{i}": (middles[i % 6] + 0.2 * rng.normal(size=8)).tolist() for i in range(300)}
    vectors |= {f"same{i}": vectors["v0"] for i in range(60)}
    vectors |= {"zero": [0.0] * 8, "none": None, "short": [1.0] * 3}
    frame = spark.createDataFrame([(i, i, v) for i, v in vectors.items()], "article_id string, chunk_id string, content_vector array<double>")
    probes = {q: (middles[q % 6] + 0.1 * rng.normal(size=8)).tolist() for q in range(12)}
    probes |= {20: [0.0] * 8, 21: None, 22: [1.0], 23: vectors["v0"]}
    queries = spark.createDataFrame(list(probes.items()), "query_id int, vector array<double>")
    found = VectorCells(str(tmp_path / "c")).build(frame, 6).search(queries, k).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    assert got == brute(vectors, probes, k)
    if k == 1:
        read = [r["cells_read"] for r in found if r["query_id"] < 12]
        assert sum(read) / len(read) < 4  # of seven


def test_hybrid_of_a_table_equals_one_by_one(spark, sf, tmp_path):
    chunks = X.corpus(spark, sf)
    rows = X.table(spark, sf, "benchmark").orderBy("item_id").limit(4).select("item_id", "text").collect()
    queries = spark.createDataFrame([(r["item_id"], r["text"]) for r in rows], "query_id long, text string").withColumn(
        "vector", embedding(F.col("text")))
    got = hits(hybrid_batch(queries, retrieval.corpus_cells(spark, sf), retrieval.corpus_index(spark, sf), 5))
    single = [Query(r["text"], r["vector"], str(r["query_id"])) for r in queries.collect()]
    wanted = {(int(r["name"]), r["chunk_id"]): round(r["score"], 9) for r in hybrid_hits(chunks, single, 5).collect()}
    assert {k: pytest.approx(v, abs=1e-8) for k, v in wanted.items()} == got


def test_postings_take_a_few_bytes_each(spark, tmp_path):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(200)))), " ")
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("article_id"),
                                    F.concat(F.md5(F.col("id").cast("string")), F.lit("_0")).alias("chunk_id"), words.alias("content"))
    index = PostingTable(str(tmp_path / "p"), 4).build(rows, ["content"])
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    asked_for = sum(r["df"] for r in spark.read.parquet(f"{index.path}/terms").collect())
    assert asked_for > 100_000 and size < 8 * asked_for  # 43 on check_s with the keys in every posting
    some = rows.limit(1).first()
    question = spark.createDataFrame([(1, some["content"])], "query_id int, text string")
    assert index.search(question, 1, BOOSTS).first()["chunk_id"] == some["chunk_id"]


def test_sums_of_fields_come_from_the_terms(spark, tmp_path):
    texts = [("a", "oak elm oak"), ("b", "elm"), ("c", ""), ("d", None), ("e", "the")]
    rows = spark.createDataFrame([(i, i, t, "title") for i, t in texts], "article_id string, chunk_id string, content string, title string")
    index = PostingTable(str(tmp_path / "p"), 4).build(rows, ["content", "title"]).change("gone", removed=rows.filter("chunk_id = 'a'"))
    sums = spark.read.parquet(f"{index.path}/terms").groupBy("batch", "field").agg(F.sum("firsts"), F.sum("words"))
    wanted = {("base", "content", 2, 4), ("base", "title", 5, 5), ("gone", "content", -1, -3), ("gone", "title", -1, -1)}
    assert {tuple(r) for r in sums.collect()} == wanted
    kept = spark.read.parquet(f"{index.path}/fields").select("batch", "field", "docs", "words")
    assert {tuple(r) for r in kept.collect()} == wanted


def test_hits_do_not_shuffle_the_chunks(spark, sf):
    from test_plans import plan

    rows = retrieval._engine(spark, sf).hybrid(retrieval.TEXT, 10)
    text = plan(rows)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
