"""Language of texts by a byte convolutional network.

Bytes (A-Z lower-cased) are embedded, filters of several widths slide over windows of a fixed
length, the greatest response of each filter in a window is kept, and a softmax
layer turns those into languages.  The network is trained in numpy on labelled
texts; tasks apply it to all windows of a text in batches and average the
windows' probabilities.

Applying needs no multiplications before the last layer: what a byte at an offset
adds to all filters is a row of a table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.base import held_out, map_arrow, small_batches, table, utf8, written

#: Labelled documents of each language the network learns from, by smallest hash of the id.
TRAIN_DOCS = 500
TRAIN_WINDOWS = 4           # of a document, evenly spread
LEAST_BYTES = 32
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8                 # of each width
EMBEDDING = 8
EPOCHS = 10
BATCH = 64
RATE = 0.01
SEED = 7
REACH = max(WIDTHS) - 1
NONE = "und"


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts with ``REACH`` bytes of what follows, the text of each, and how many of its bytes are text."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    flat = np.frombuffer(b"".join([t + bytes(n * WINDOW - len(t)) for t, n in zip(texts, counts)]), np.uint8)
    body = flat.reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros((len(body), WINDOW + REACH), np.uint8)
    out[:, :WINDOW] = body
    if len(body):
        same = owner[1:] == owner[:-1]
        out[:-1, WINDOW:][same] = body[1:, :REACH][same]
    size = np.full(len(body), WINDOW)
    ends = np.cumsum(counts) - 1
    full = np.array([n > 0 for n in counts], bool)
    size[ends[full]] = (np.fromiter(map(len, texts), np.int64, len(texts)) - (np.array(counts) - 1) * WINDOW)[full]
    return out, owner, size


class Network:
    """Parameters of the network for a list of languages."""

    def __init__(self, languages: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.values = {"embedding": draw.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.values[f"conv{w}"] = draw.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS))
        n = FILTERS * len(WIDTHS)
        self.values |= {"bias": np.zeros(n), "out": draw.normal(0, n ** -0.5, (n, len(languages))),
                        "out_bias": np.zeros(len(languages))}
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.values.items()}
        self.steps = 0

    def tables(self) -> np.ndarray:
        """What each byte at each offset adds to all filters: (offsets, 256, filters)."""
        made = np.zeros((REACH + 1, 256, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            for offset in range(w):
                made[offset, :, k * FILTERS:(k + 1) * FILTERS] = self.values["embedding"] @ self.values[f"conv{w}"][offset]
        return made

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """One Adam step on windows ``x`` with languages ``y``."""
        v, n = self.values, len(x)
        tables, rows = self.tables(), np.arange(n)[:, None]
        response = sum(tables[o][x[:, o:o + WINDOW]] for o in range(REACH + 1))
        place = response.argmax(axis=1)                                   # (n, filters)
        peak = np.take_along_axis(response, place[:, None], 1)[:, 0] + v["bias"]
        pooled = np.maximum(peak, 0)
        logits = pooled @ v["out"] + v["out_bias"]
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(n), y] -= 1
        chance /= n
        down = (chance @ v["out"].T) * (peak > 0)
        grads = {"out": pooled.T @ chance, "out_bias": chance.sum(axis=0), "bias": down.sum(axis=0),
                 "embedding": np.zeros_like(v["embedding"])}
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            conv, grad = v[f"conv{w}"], np.zeros_like(v[f"conv{w}"])
            for offset in range(w):
                byte = x[rows, place[:, own] + offset]                     # (n, filters)
                grad[offset] = np.einsum("nfe,nf->ef", v["embedding"][byte], down[:, own])
                add = down[:, own][:, :, None] * conv[offset].T[None]      # (n, filters, embedding)
                np.add.at(grads["embedding"], byte.ravel(), add.reshape(-1, EMBEDDING))
            grads[f"conv{w}"] = grad
        self.steps += 1
        for k, g in grads.items():
            first, second = self.moments[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            v[k] -= RATE * (first / (1 - 0.9 ** self.steps)) / (np.sqrt(second / (1 - 0.999 ** self.steps)) + 1e-8)


class Reader:
    """The trained network, ready to be applied."""

    def __init__(self, network: Network):
        self.languages, self.tables = network.languages, network.tables()
        self.bias, self.out, self.out_bias = (network.values[k].astype(np.float32) for k in ("bias", "out", "out_bias"))

    def log_chances(self, windows: np.ndarray) -> np.ndarray:
        made = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 64):  # a size that stays in the processor's cache
            x = windows[at:at + 64]
            response = self.tables[0].take(x[:, :WINDOW], axis=0)
            for offset in range(1, REACH + 1):
                response += self.tables[offset].take(x[:, offset:offset + WINDOW], axis=0)
            logits = np.maximum(response.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            made[at:at + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return made

    def read(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.languages:
            return [NONE] * len(texts), [0.0] * len(texts)
        windows, owner, size = windows_of([t.encode().lower() if ok else b"" for t, ok in zip(texts, lettered)])
        logs = self.log_chances(windows)
        # the share of a text's bytes that looks like each language
        total = np.stack([np.bincount(owner, np.exp(logs[:, k]) * size, len(texts)) for k in range(logs.shape[1])], 1)
        chance = total / np.maximum(np.bincount(owner, size, len(texts)), 1)[:, None]
        best = chance.argmax(axis=1)
        return ([self.languages[b] if ok else NONE for b, ok in zip(best, lettered)],
                [min(float(c[b]), 1.0) if ok else 0.0 for c, b, ok in zip(chance, best, lettered)])


def _smallest_hashes(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each ``lang`` with the smallest hash of ``doc_id``.

    Counts by the first twelve bits of the hash say how far to read, so that a
    language's rows do not meet: tasks send counts, then little more than ``n`` rows.
    """
    marked = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("part", F.shiftright("hash", 52))
    counts = marked.groupBy("lang", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    last = (counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < n)
            .groupBy("lang").agg(F.max("part").alias("last")))  # a row for each language
    near = marked.join(F.broadcast(last), "lang").filter(F.col("part") <= F.col("last"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    return near.withColumn("at", at).filter(F.col("at") <= n).select("doc_id", "lang")


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Reader:
    """Network from the texts and languages of documents outside the held-out fold.

    Rows with a null id, text or language are not used.  Of each language at most
    ``train_docs`` rows are, those of the smallest hash of the id; the training
    runs on the driver over ``TRAIN_WINDOWS`` windows of each, windows of less than
    ``LEAST_BYTES`` bytes only where a text has no others.
    """
    usable = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
              .filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"))))
    chosen = written(_smallest_hashes(usable.select("doc_id", "lang"), train_docs).distinct(), "lang-labels")

    def cut(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            windows, owner, size = windows_of([t.lower() for t in utf8(batch, "text")])
            keep: list[int] = []
            for k in range(len(langs)):
                own = np.flatnonzero(owner == k)
                if len(own) and size[own].max() >= LEAST_BYTES:
                    own = own[size[own] >= LEAST_BYTES]  # a short end says little where the text has more
                keep += own[np.unique(np.linspace(0, len(own) - 1, TRAIN_WINDOWS).astype(int))].tolist() if len(own) else []
            yield {"doc_id": batch.column("doc_id").take(_indices(owner[keep])), "lang": [langs[k] for k in owner[keep]],
                   "window": [windows[k].tobytes() for k in keep]}

    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"])  # train_docs ids of each language
    rows = map_arrow(texts, cut, "doc_id long, lang string, window binary").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "window"], ignore_index=True)
    languages = sorted(rows["lang"].unique())
    network = Network(languages)
    if len(languages) > 1:
        x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(len(rows), -1)
        y = rows["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy()
        # languages at equal weight: each is drawn alike
        draw = np.random.default_rng(SEED)
        by = [np.flatnonzero(y == k) for k in range(len(languages))]
        for _ in range(EPOCHS * max(1, len(rows) // BATCH)):
            pick = np.concatenate([draw.choice(b, max(1, BATCH // len(languages))) for b in by])
            network.train(x[pick], y[pick])
    return Reader(network)


def _indices(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values, pa.int64())


def predicted(docs: DataFrame, reader: Reader) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Texts that are null or have no letter are ``und`` with score 0; so is every
    text if there was nothing to learn from.  A null id is not held out.  Only
    ``doc_id`` and ``text`` are looked at, and the id is no input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(reader)  # a fixed size for each language

    def run(batches):
        for batch in batches:
            langs, scores = shared.value.read(batch.column("text").to_pylist())
            yield {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(source, run, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
