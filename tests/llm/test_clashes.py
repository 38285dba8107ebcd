"""Working columns that callers have too, short texts, rates as expressions, literals of source code."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup, langid, mixing, secret_scan, simhash, toxicity

CLASHES = ["_tokens", "_text", "_posterior", "_rate", "_domain", "_copies", "_copy", "_ratio", "_row", "_sha256",
           "gone_id", "gone_sha256", "c0", "c1", "C5", "a.b", "toxic", "n"]


def test_columns_of_any_name_pass_through_the_stages(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(k, text if k % 3 == 0 else f"{text} more {k} {k * 7}", *["x"] * len(CLASHES)) for k in range(1, 9)]
    rows += [(None, None, *[None] * len(CLASHES)), (2, "", *["y"] * len(CLASHES))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    mixed = mixing.mixed(docs, labels, {"good": 0.5, "poor": 0.5})
    assert mixed.columns == docs.columns
    assert {r["_copy"] for r in mixed.collect()} <= {"x", "y", None}
    plain = docs.drop("a.b")
    for stage in (exact_dedup.keep_first, simhash.keep_first):
        assert stage(plain).columns == plain.columns
    for empty in (toxicity.keep_clean(docs.limit(0), labels), mixing.mixed(docs.limit(0), labels, {"good": 1.0})):
        assert empty.isEmpty() and empty.columns == docs.columns


def test_rates_in_the_plan_are_those_of_the_steps(spark):
    draw = np.random.default_rng(3)
    posterior = draw.dirichlet([1, 1, 1], 50)
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(posterior)], "k int, p array<double>")
    for steps in (0, 1, 7):
        gradients = draw.normal(0, 0.4, (steps, 3))
        got = rows.select("k", mixing.rate_after("p", gradients).alias("r")).orderBy("k").toPandas()["r"]
        assert np.allclose(got, mixing.rates_after(posterior, gradients), atol=1e-12)


def test_a_language_of_short_texts_is_learned(spark):
    rows = [(k, "de", f"das ist ein {k:03}") for k in range(60)] + [(100 + k, "en", f"this is the long text {k:03} " * 5) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    reader = langid.fit(docs)
    assert reader.languages == ["de", "en"]
    found = langid.predicted(docs, reader).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert found and sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)


def test_the_training_rows_are_those_of_the_smallest_hashes(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("lang"))
    rows = rows.unionByName(rows.filter("doc_id % 7 = 0"))
    for n in (1, 40, 5000):
        got = sorted(map(tuple, langid._smallest_hashes(rows, n).collect()))
        ranked = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
        want = [[(r.doc_id, r.lang) for r in ranked if r.lang == lang][:n] for lang in ("hot", "rare")]
        assert got == sorted(want[0] + want[1])


def test_names_calls_and_tags_are_no_literals():
    for text in ("password_field = some_variable_name", "primary_key = customer_id", 'secret_key = os.environ["K"]',
                 "auth_token = get_token(user)", "db_password: !vault", "db_password = ${DB_PASS}", "auth_key: *shared"):
        assert secret_scan.named_literals(text) == [], text


def test_strings_with_escapes_and_long_strings():
    def found(text):
        return [text[s:e] for s, e, _ in secret_scan.named_literals(text)]

    assert found(r'db_password = "say \"hi\" Zx81kQ"') == [r'say \"hi\" Zx81kQ']
    assert found('private_key = """\nMIIEow9Xk2\nQq81Zx\n"""') == ["\nMIIEow9Xk2\nQq81Zx\n"]
    assert found("auth_salt = '''Zx81kQ77'''") == ["Zx81kQ77"]
    assert found("db_password: Zx81kQ_77") == ["Zx81kQ_77"]
    assert found('password_label = "Please enter the password"') == []
    assert found("k1 = 'Zx81kQ77'\nk2 = k1\ndb_password = k2") == ["Zx81kQ77"]
    text = 'key="' * 20_000 + "key='''" * 20_000 + 'a="""' * 20_001
    secret_scan.named_literals(text)
