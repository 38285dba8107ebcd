"""Mixing documents to target weights of domains they belong to softly.

A classifier learned from a labelled table gives every document a posterior over
the domains.  A document of ``t`` tokens, posterior ``p`` and rate ``r`` adds
``r * t * p`` to the domains' expected tokens; the rates are the nonnegative
least-squares fit of those totals to the targets that is reached from rate one by
projected gradient steps.

A step needs the domains' totals only: a number for each domain and task.  The
rates follow from the gradients of all steps so far, so no step rewrites rows,
and what tasks receive is a short list of gradients.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import BatchWords, hashed, held_out, map_arrow, numbered_columns, small_batches, table, written

#: Labelled documents of each domain the classifier learns from, by smallest hash of the id.
TRAIN_DOCS = 2_000
FEATURES = 1 << 16
EPOCHS = 6
MAX_STEPS = 30
BATCH_BYTES = "3m"          # a batch's words and features take some thirty times its texts
TOLERANCE = 1e-6            # of the targets' sum

#: Share of the tokens each domain is to have, where nothing else is asked.
WEIGHTS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


# --- posteriors -------------------------------------------------------------

class Features:
    """Hash features of a batch: the different words of each text, and the shapes they have.

    ``row`` and ``feature`` list the pairs, sorted; ``tokens`` counts the words.
    A shape is a word's case, its number of signs and the sign it ends with.
    """

    def __init__(self, texts: pa.Array):
        words = BatchWords(texts)
        word = words.different
        signs = pc.subtract(pc.utf8_length(word), pc.utf8_length(pc.replace_substring_regex(word, r"[^\pL]", "")))
        last = pc.replace_substring_regex(pc.utf8_slice_codeunits(word, -1), r"\pL", "")
        shape = pc.binary_join_element_wise(pc.if_else(pc.utf8_is_upper(word), "upper", "lower"),
                                            pc.cast(pc.min_element_wise(signs, 4), pa.string()), last, "\0")
        bare = pc.utf8_trim(pc.utf8_lower(word), characters=".,!?")
        found = [(hashed(x) % np.uint64(FEATURES)).astype(np.int64) for x in (bare, shape)]
        pairs = np.unique(np.concatenate([words.row * FEATURES + f[words.code] for f in found]))
        self.row, self.feature, self.rows, self.tokens = pairs // FEATURES, pairs % FEATURES, words.rows, words.sizes()


class Softmax:
    """Linear model over feature sets scaled to length one."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.astype(np.float32), bias

    def posteriors(self, found: Features) -> np.ndarray:
        each = self.weights[found.feature]
        sums = np.stack([np.bincount(found.row, each[:, k], found.rows) for k in range(len(self.bias))], 1)
        sizes = np.bincount(found.row, minlength=found.rows)
        return _chances(sums / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias)


def _chances(logits: np.ndarray) -> np.ndarray:
    chance = np.exp(logits - logits.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def learned(sets: list[np.ndarray], domain: np.ndarray, n: int, epochs: int = EPOCHS) -> Softmax:
    """Softmax regression by adaptive gradient steps over batches, in the order given."""
    weights, square = np.zeros((FEATURES, n)), np.full((FEATURES, n), 1e-6)
    counts = np.bincount(domain, minlength=n)
    bias = np.log((counts + 1) / (counts + 1).sum())
    for _ in range(epochs):
        for at in range(0, len(sets), 64):
            part, target = sets[at:at + 64], domain[at:at + 64]
            chance = _chances(np.stack([weights[s].sum(axis=0) / np.sqrt(max(len(s), 1)) for s in part]) + bias)
            chance[np.arange(len(part)), target] -= 1
            sizes = np.array([len(s) for s in part])
            flat = np.concatenate(part) if len(part) else np.zeros(0, np.int64)
            used, where = np.unique(flat, return_inverse=True)
            scaled = chance / np.sqrt(np.maximum(sizes, 1))[:, None]
            each = np.repeat(np.arange(len(part)), sizes)
            gradient = np.stack([np.bincount(where, scaled[each, k], len(used)) for k in range(n)], 1)
            square[used] += gradient ** 2
            weights[used] -= 0.5 * gradient / np.sqrt(square[used])
    return Softmax(weights, bias)


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], train_docs: int = TRAIN_DOCS) -> Softmax:
    """Classifier from ``labelled (doc_id, domain)``; ids labelled more than once count under each label."""
    usable = (labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct()
              .filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).filter(~held_out(F.col("doc_id"))))
    chosen = None
    for name in domains:
        own = usable.filter(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = written(chosen, "mixing-labels")

    def run(batches):
        for batch in batches:
            found = Features(batch.column("text"))
            cuts = np.searchsorted(found.row, np.arange(found.rows + 1)).tolist()
            yield {"doc_id": batch.column("doc_id"), "domain": batch.column("domain"),
                   "features": [found.feature[a:b] for a, b in zip(cuts, cuts[1:])]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = map_arrow(texts, run, "doc_id long, domain string, features array<int>").toPandas()
    rows = rows.assign(order=[xxhash.xxh32_intdigest(str(i)) for i in rows["doc_id"]]).sort_values(["order", "domain"])
    model = learned([np.asarray(f, np.int64) for f in rows["features"]],
                   np.array([domains.index(d) for d in rows["domain"]], np.int64), len(domains))
    # the sample has other shares than the labels
    found = {r[0]: r[1] for r in usable.groupBy("domain").count().collect()}
    sample = rows["domain"].value_counts()
    model.bias = model.bias + np.log([(found.get(d, 0) + 1) / (sample.get(d, 0) + 1) for d in domains])
    return model


# --- rates ------------------------------------------------------------------

def rates_after(posterior: np.ndarray, gradients: np.ndarray) -> np.ndarray:
    """Rates of documents after projected steps along ``gradients (steps, domains)`` from rate one."""
    rate = np.ones(len(posterior))
    for gradient in gradients:
        np.maximum(rate - posterior @ gradient, 0, out=rate)
    return rate


def rate_after(posterior: str, gradients: np.ndarray) -> Column:
    """:func:`rates_after` as an expression, so that texts beside the posteriors stay where they are."""
    steps = F.array(*[F.array(*[F.lit(float(g)) for g in gradient]) for gradient in gradients])
    if not len(gradients):
        return F.lit(1.0)
    moved = lambda rate, step: F.greatest(rate - sum(
        F.col(posterior)[k] * step[k] for k in range(gradients.shape[1])), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), moved)


def _matrix(column, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def fitted_gradients(marked: DataFrame, weights: list[float], max_steps: int = MAX_STEPS) -> np.ndarray:
    """Gradients of the steps that take the expected totals of ``marked (tokens, posterior)`` to the targets.

    The squared misses are weighted with the inverse of ``sum t p p'`` over the
    documents whose rate is not zero.  In that measure a full step lands on the
    targets unless more rates are cut at zero; the steps after it mend what the
    cuts left, and one that leads away is taken again at half its length.
    """
    n = len(weights)

    def totals(gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            total, curve = np.zeros(n), np.zeros((n, n))
            for batch in batches:
                if batch.num_rows:
                    p, t = _matrix(batch.column("posterior"), n), batch.column("tokens").to_numpy().astype(float)
                    rate = rates_after(p, gradients)
                    total += p.T @ (t * rate)
                    curve += (p * (t * (rate > 0))[:, None]).T @ p
            yield {"total": [total.tolist() + curve.ravel().tolist()]}

        rows = map_arrow(marked.select("tokens", "posterior"), run, "total array<double>")
        parts = rows.select([F.col("total")[k].alias(f"t{k}") for k in range(n + n * n)])
        found = np.array([x or 0.0 for x in parts.agg(*[F.sum(c).alias(c) for c in parts.columns]).first()])
        return found[:n], found[n:].reshape(n, n)

    gradients, least, step = np.zeros((0, n)), np.inf, 1.0
    now, curve = totals(gradients)
    target = np.array(weights) / sum(weights) * now.sum()
    for _ in range(max_steps):
        miss = np.abs(now - target).max()
        if miss <= TOLERANCE * max(target.sum(), 1):
            break
        if miss < least:
            least, base, step = miss, (gradients, now, curve), 1.0
        else:
            step /= 2  # too far: again from the best rates, half as far
            if step < 1e-3:
                break
        gradients, now, curve = base
        gradients = np.vstack([gradients, step * np.linalg.pinv(curve, rcond=1e-10, hermitian=True) @ (now - target)])
        now, curve = totals(gradients)
    return gradients if np.abs(now - target).max() <= least else base[0]


def mixture(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] = WEIGHTS,
            keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs``, all by default, with ``_tokens, _domain, _posterior, _rate, _copies``.

    ``labelled``: ``doc_id, domain``.  Tokens are white-space separated words.
    ``_copies`` rounds the rate up or down by a hash of the id, so that it is the
    rate on average.  Null and empty texts have no tokens and the posterior of
    the domains' frequencies; their rate moves no total.  Targets that no rates
    reach are approached.  Rows that repeat an id are documents each.  An empty
    table gives an empty result.  What is kept is written once with the
    posteriors, so texts are classified once.
    """
    spark = docs.sparkSession
    small_batches(spark, size=BATCH_BYTES)
    domains = list(weights)
    names = docs.columns if keep is None else keep
    model = spark.sparkContext.broadcast(fit(docs, labelled, domains))  # FEATURES weights for each domain
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)

    text = "text" if "text" in names else "_text"  # whole texts go to Python once

    def marks(batches):
        for batch in batches:
            found = Features(batch.column(text))
            yield {c: batch.column(c) for c in names} | {
                "_tokens": found.tokens, "_posterior": model.value.posteriors(found).tolist()}

    order = [f.name for f in docs.schema if f.name in names]
    source = docs.select(*order) if text == "text" else docs.select(*order, F.col("text").alias(text))
    marked = written(map_arrow(source, marks, kinds + "_tokens long, _posterior array<double>"), "posteriors")
    model.destroy()
    gradients = fitted_gradients(
        marked.select(F.col("_tokens").alias("tokens"), F.col("_posterior").alias("posterior")), list(weights.values()))

    rate = rate_after("_posterior", gradients)
    likeliest = F.array_position("_posterior", F.array_max("_posterior")).cast("int")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return marked.select("*", F.element_at(F.array(*map(F.lit, domains)), likeliest).alias("_domain"), rate.alias("_rate"),
                         F.floor(rate + spread).cast("int").alias("_copies"))


def domains_of(labels: DataFrame) -> DataFrame:
    """Domains of the label table: toxic, and good or poor by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
                         .when(F.col("quality") == 0, "poor").alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``docs`` with every row as often as its copies say.

    Null, empty, very long and repeated rows are as in :func:`mixture`; columns of
    any name pass through; an empty table stays empty.
    """
    inner, back = numbered_columns(docs)
    rows = mixture(inner, domains_of(labels), weights).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*back)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = mixture(docs, domains_of(table(spark, sf_dir, "labels")), keep=["doc_id"])
    return rows.select("doc_id", F.col("_tokens").alias("tokens"), F.col("_domain").alias("domain"),
                       *[F.col("_posterior")[k].alias(f"p_{name}") for k, name in enumerate(WEIGHTS)],
                       F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
