"""Toxicity from two class-conditional Kneser-Ney models.

As in Kneser-Ney smoothing, a word counts in a class with the number of different
words it follows, not with its tokens, so the wording of one text that was copied
a hundred times counts once.  A word's chance in a class is interpolated over three
levels: the discounted counts of the class, those of both classes together, and
the word's share in the whole corpus.  The weight of the class against the shared
counts is the posterior chance that the classes differ in this word at all, from
how far its log ratio lies beyond what its counts and the usual spread of topics
explain, where one word of the vocabulary is expected to.  So a rare expression
takes nearly all of its chance from the shared counts and moves towards its class
with every further context; every word is scored and none is cut off.

A text's score is a logistic function of the difference of its log-likelihoods per
word, fitted on labelled texts the models were not counted from.  A word no
labelled text has falls back to the same shared chance in both classes, so the
models hold the words of the labelled texts and nothing is lost by that.

Counts are tables keyed by word.  Tasks get the models whole while they hold at
most ``HELD_WORDS`` words; beyond that, words and models meet in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import BatchWords, hashed, held_out, map_arrow, numbered_columns, small_batches, table, written

#: Labelled documents of each class the models and the calibration use, by smallest hash of the id.
TRAIN_DOCS = 4_000
HELD_WORDS = 1 << 21        # of the models, 16 bytes each, a task holds
FOLDED_WORDS = 1 << 19      # counts a task folds before it hands them on
DISCOUNT = 0.75
SPREAD = 0.5                # variance of log ratios from topic and language
CALIBRATION_FOLD = 1        # of crc32(doc_id) mod 5; fold 0 is held out


# --- words ------------------------------------------------------------------

class Numbers(BatchWords):
    """Words of a batch with a 64-bit number for each, from its lower-cased form without the signs around it."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        lower = pc.utf8_lower(self.different)
        bare = pc.replace_substring_regex(lower, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
        self.numbers = hashed(pc.if_else(pc.equal(bare, ""), lower, bare)).view(np.int64)


def shared_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each word stands in all documents."""
    def folded(parts):
        word, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return word, np.bincount(at, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)

    def run(batches):
        held = []
        for batch in batches:
            words = Numbers(batch.column("text"))
            held.append((words.numbers, np.bincount(words.code, minlength=len(words.numbers))))
            if sum(len(h[0]) for h in held) >= FOLDED_WORDS:
                held = [folded(held)]
                if len(held[0][0]) >= FOLDED_WORDS // 2:
                    yield dict(zip(("word", "n"), held.pop()))
        if held:
            yield dict(zip(("word", "n"), folded(held)))

    return (map_arrow(docs.select("text"), run, "word long, n long").filter("n > 0")
            .groupBy("word").agg(F.sum("n").alias("n")))


def contexts(labelled: DataFrame) -> DataFrame:
    """``toxic, before, word``: the different word pairs of either class, -1 before a text."""
    def run(batches):
        for batch in batches:
            words = Numbers(batch.column("text"))
            number = words.numbers[words.code]
            before = np.concatenate(([-1], number))[:-1] if len(number) else number
            before[np.diff(words.row, prepend=-1) != 0] = -1
            yield {"toxic": batch.column("toxic").to_numpy()[words.row], "before": before, "word": number}

    return map_arrow(labelled.select("text", "toxic"), run, "toxic int, before long, word long").distinct()


# --- models -----------------------------------------------------------------

def chances(words: DataFrame, shared: DataFrame) -> DataFrame:
    """``word, ratio``: log ratio of the classes' interpolated chances.

    ``words``: ``word, t, o``, contexts in toxic and ordinary texts; ``shared``:
    ``word, n``.  Empty unless both classes have words.
    """
    mt, mo, kt, ko, kinds = (float(x or 0) for x in words.agg(
        F.sum("t"), F.sum("o"), F.count_if(F.col("t") > 0), F.count_if(F.col("o") > 0), F.count("*")).first())
    if not mt or not mo:
        return words.select("word", F.lit(0.0).alias("ratio")).limit(0)
    tokens, corpus_kinds = (float(x or 0) for x in shared.agg(F.sum("n"), F.count("*")).first())
    t, o = F.col("t"), F.col("o")
    low = (F.coalesce(F.col("n"), F.lit(0)) + 0.5) / (tokens + 0.5 * corpus_kinds + 0.5)

    def smoothed(count: Column, different: float, mass: float) -> Column:
        return (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * different * low) / mass

    apart = F.log((t + 0.5) / mt) - F.log((o + 0.5) / mo)
    beyond = apart * apart / (1 / (t + 0.5) + 1 / (o + 0.5) + SPREAD)
    weight = 1 / (1 + kinds * F.exp(-beyond / 2))
    both = smoothed(t + o, kinds, mt + mo)
    mixed = [F.log(weight * smoothed(c, k, m) + (1 - weight) * both) for c, k, m in ((t, kt, mt), (o, ko, mo))]
    return words.join(shared, "word", "left").select("word", (mixed[0] - mixed[1]).alias("ratio"))


def counted(labelled: DataFrame, docs: DataFrame) -> DataFrame:
    """``word, ratio`` of every word of the labelled texts, written."""
    words = written(contexts(labelled).groupBy("word").agg(
        F.sum(F.col("toxic").cast("long")).alias("t"), F.sum(1 - F.col("toxic").cast("long")).alias("o")), "toxic-words")
    return written(chances(words, written(shared_counts(docs), "toxic-shared")), "toxic-models")


def ratios(docs: DataFrame, models: DataFrame, keep: list[str], held_words: int = HELD_WORDS) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``_ratio``, the difference of log-likelihoods per word."""
    if models.count() > held_words:
        return _joined_ratios(docs, models, keep)
    found = models.toPandas().sort_values("word")  # held_words rows at most
    shared = docs.sparkSession.sparkContext.broadcast((found["word"].to_numpy(np.int64), found["ratio"].to_numpy(float)))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    text = "text" if "text" in keep else "_text"  # whole texts go to Python once

    def run(batches):
        number, ratio = shared.value
        for batch in batches:
            words = Numbers(batch.column(text))
            at = np.searchsorted(number, words.numbers)
            at[at == len(number)] = 0
            each = np.where(number[at] == words.numbers, ratio[at], 0.0) if len(number) else np.zeros(len(at))
            total = np.bincount(words.row, each[words.code], words.rows)
            yield {n: batch.column(n) for n in keep} | {"_ratio": total / np.maximum(words.sizes(), 1)}

    source = docs.select(*keep) if text == "text" else docs.select(*keep, F.col("text").alias(text))
    return map_arrow(source, run, ", ".join(f"`{n}` {fields[n]}" for n in keep) + ", _ratio double")


def _joined_ratios(docs: DataFrame, models: DataFrame, keep: list[str]) -> DataFrame:
    """:func:`ratios` with models of any size: a document's different words meet them in a join."""
    rows = written(docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_at", F.monotonically_increasing_id()), "toxic-rows")

    def run(batches):
        for batch in batches:
            words = Numbers(batch.column("text"))
            pairs, n = np.unique(words.row * len(words.numbers) + words.code, return_counts=True)
            row, code = np.divmod(pairs, max(len(words.numbers), 1))
            yield {"_at": batch.column("_at").to_numpy()[row], "word": words.numbers[code], "part": n / words.sizes()[row]}

    spread = map_arrow(rows.select("_at", "text"), run, "_at long, word long, part double")
    summed = spread.join(models, "word").groupBy("_at").agg(F.sum(F.col("part") * F.col("ratio")).alias("_ratio"))
    return rows.join(summed, "_at", "left").select(*keep, F.coalesce("_ratio", F.lit(0.0)).alias("_ratio"))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through one half where the classes are best told apart.

    The point is the middle of the gap that leaves the smallest balanced error;
    the slope takes the median of the toxic texts to 0.95.
    """
    toxic, clean = np.sort(x[y == 1]), np.sort(x[y == 0])
    if not len(toxic) or not len(clean):
        return 1.0, -1.0
    values = np.unique(np.append(x[x > 0], 0.0))  # a text without evidence is not toxic
    cuts = np.append((values[:-1] + values[1:]) / 2, values[-1] + 1)
    missed = np.searchsorted(toxic, cuts) / len(toxic)
    false = 1 - np.searchsorted(clean, cuts) / len(clean)
    cut = float(cuts[np.argmin(missed + false)])
    slope = 3 / max(float(np.median(toxic)) - cut, 1e-3)
    return slope, -slope * cut


class Fitted:
    def __init__(self, models: DataFrame, slope: float, offset: float):
        self.models, self.slope, self.offset = models, slope, offset

    def score(self) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("_ratio") + F.lit(self.offset))))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Fitted:
    """Models from labelled documents outside the held-out fold; shared counts from all documents.

    ``labels``: ``doc_id, toxic``.  Rows with a null id or label are not used; an
    id labelled more than once is toxic if any of its labels says so.  Of each
    class at most ``train_docs`` labelled ids are used, those of the smallest hash.
    Without labels of both classes every text scores one half or less.
    """
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    toxic, ordinary = (usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
                       for label in (1, 0))
    chosen = written(toxic.unionByName(ordinary), "toxic-labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(F.broadcast(chosen), "doc_id").withColumn("fold", fold))  # 2 * train_docs rows at most
    models = counted(texts.filter(F.col("fold") != CALIBRATION_FOLD), docs)
    seen = ratios(texts.filter(F.col("fold") == CALIBRATION_FOLD), models, ["toxic"]).toPandas()
    return Fitted(models, *logistic(seen["_ratio"].to_numpy(np.float64), seen["toxic"].to_numpy(np.float64)))


def scored(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """``doc_id, held_out, score, predicted, ratio`` of every row of ``docs``.

    Null and empty texts have ratio 0.  A null id is not held out.  Only
    ``doc_id`` and ``text`` are looked at, and the id is no input of the score.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (ratios(source, fitted.models, ["doc_id"]).withColumn("score", fitted.score())
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("_ratio").alias("ratio")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic.

    Null and empty texts stay, and so do all rows that repeat a clean one; columns
    of any name pass through; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    inner, back = numbered_columns(docs)
    fitted = fit(inner, labels)
    return ratios(inner, fitted.models, inner.columns).filter(fitted.score() < 0.5).select(*back)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
