"""URL verdicts: host and path rules, and a logistic regression where no rule fits.

Everything runs in SQL functions.  The model is a bag of hashed character
n-grams of host and path; it learns from a small table of labelled URLs, here the
URLs of the input that a rule decides.  The only thing that leaves Spark is the
vector of ``SLOTS`` weights, which every gradient step reads and writes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import table, written

#: Rules: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Labelled URLs of each verdict the model learns from, by smallest hash.
TRAIN_URLS = 1_000
SLOTS = 1 << 11
GRAMS = (3, 4)
STEPS = 20
RATE = 0.5
PRIOR = 1e-3


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """Position of the longest fitting rule, null if none fits."""
    rules = RULES if rules is None else rules
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    found = F.lit(None).cast("int")
    for k in reversed(order):
        _, own_host, own_path = rules[k]
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def slots_of(host: Column, path: Column) -> Column:
    """Hash slots of the different character n-grams of host and path, with their ends marked."""
    def grams(text: Column, size: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(size))), F.lit(SLOTS)).cast("int"))

    marked = [F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("="), path, F.lit("$"))]
    return F.array_distinct(F.concat(*[grams(text, size) for text in marked for size in GRAMS]))


def margin(slots: Column, weights: list[float], bias: float) -> Column:
    """Linear score of slot lists; the weights are one folded constant."""
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(slots, F.lit(0.0), lambda s, x: s + F.element_at(held, x + 1))
    return total / F.sqrt(F.greatest(F.size(slots), F.lit(1)).cast("double")) + F.lit(bias)


def fit(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias from ``labelled (slots, y)``: adaptive gradient steps over the whole small table."""
    total = labelled.agg(F.count("*"), F.sum("y")).first()
    weights, square, n = [0.0] * SLOTS, [1e-6] * SLOTS, total[0]
    if not n:
        return weights, 0.0
    share = (total[1] + 1) / (n + 2)
    bias = math.log(share / (1 - share))
    for _ in range(steps):
        miss = 1 / (1 + F.exp(-margin(F.col("slots"), weights, bias))) - F.col("y")
        scaled = miss / F.sqrt(F.greatest(F.size("slots"), F.lit(1)).cast("double"))
        rows = (labelled.select(F.explode("slots").alias("slot"), scaled.alias("g")).groupBy("slot")
                .agg(F.sum("g").alias("g")).collect())  # SLOTS rows at most
        for slot, g in rows:
            g = g / n + PRIOR * weights[slot] / n
            square[slot] += g * g
            weights[slot] -= RATE * g / math.sqrt(square[slot])
    return weights, bias


def judged(pages: DataFrame, rules=None, train_urls: int = TRAIN_URLS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages (page_id, url)``.

    Null URLs and URLs without ``://`` have empty host and path and go to the
    model like others.  ``score`` is the model's chance of allow.  The model
    learns from at most ``train_urls`` different URLs of each verdict that rules
    decide, those of the smallest hash; without any it allows.  Rows that repeat
    an id are judged each; other columns are not looked at.
    """
    rules = RULES if rules is None else rules
    names = F.from_json(F.lit(json.dumps([h + p for _, h, p in rules])), "array<string>")
    allows = F.from_json(F.lit(json.dumps([v == "allow" for v, _, _ in rules])), "array<boolean>")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
    decided = (rows.filter(F.col("at").isNotNull()).select("host", "path", F.element_at(allows, F.col("at") + 1).alias("ok"))
               .groupBy("host", "path").agg(F.first("ok").alias("ok")))
    chosen = [decided.filter(F.col("ok") == ok).orderBy(F.xxhash64("host", "path"), "host", "path").limit(train_urls)
              for ok in (True, False)]
    labelled = written(chosen[0].unionByName(chosen[1]).select(
        slots_of(F.col("host"), F.col("path")).alias("slots"), F.col("ok").cast("double").alias("y")).coalesce(2), "url-labels")
    weights, bias = fit(labelled)
    score = 1 / (1 + F.exp(-margin(slots_of(F.col("host"), F.col("path")), weights, bias)))
    rule = F.element_at(names, F.col("at") + 1)
    verdict = F.when(F.element_at(allows, F.col("at") + 1), "allow").when(F.col("at").isNotNull(), "block").otherwise(
        F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return (rows.withColumn("score", score)
            .select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))
