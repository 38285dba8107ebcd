"""The pipeline's stages, one after another."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from newsloom.llm import exact_dedup, simhash
from newsloom.llm.base import written

SF = "/root/testdata/sf0.01"  # the smallest tables label too few toxic documents


def test_stages(spark):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert sorted(out.columns) == sorted(columns)
        docs = out
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.filter("toxic = 0").select("doc_id")
    before, after = seen["toxicity"]
    assert after.join(clean, "doc_id").count() == before.join(clean, "doc_id").count()
    assert after.count() < before.count()

    before, after = seen["exact_dedup"]
    squeezed = exact_dedup.squeezed(F.col("text"))
    assert after.count() == before.select(squeezed).distinct().count() == after.select(squeezed).distinct().count()

    before, after = seen["near_dedup"]
    assert simhash.similar_groups(after).count() == 0
    assert after.count() == before.count() - simhash.similar_groups(before).count()

    before, after = seen["mixing"]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["packing"]
    assert after.filter("piece = 0").count() == before.count()


def test_stages_of_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_stages_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", None, 0), (None, "a b", "en", "s", 3),
                                 (90_003, "w " * 20_000, None, "s", None), (90_003, "w " * 20_000, None, "s", None)],
                                docs.schema)
    for name, stage in pipeline.STAGES:
        odd = written(stage(spark, odd, sf), name)
        assert odd.count() > 0


def test_stages_pass_columns_of_any_name_through(spark):
    rows = [(1, "a b c d e f g h", 1, 2, "x", 0), (2, "a b c d e f g h", 1, 2, "y", 0), (2, "other text of its own", 1, 2, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, _row int, _sha256 string, gone_sha256 int")
    for stage in (exact_dedup.keep_first, simhash.keep_first):
        kept = stage(docs)
        assert kept.columns == docs.columns and sorted(r._sha256 for r in kept.collect()) == ["x", "z"]
