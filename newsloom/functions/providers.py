"""Embedding and summary providers.

A provider is a plain object whose work happens inside Arrow batches of the
task that holds the rows.  The defaults are deterministic and need no service:
a word-bucket histogram as the vector and leading sentences as the summary.
They stand in for the remote models; they are not language models.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from newsloom import constants as C
from newsloom.functions import text as X
from newsloom.functions.terms import BatchTerms

WORD_RE = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """One row per text."""


def word_bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim


class WordHistogram:
    """Counts of hashed words, scaled to length one.

    Integer counts make the vector independent of word order and of the
    platform; a text without words has the zero vector.
    """

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        found = BatchTerms(texts)
        bucket = np.zeros(len(found.terms), np.int64)
        for term in np.unique(found.term).tolist():
            bucket[term] = word_bucket(found.terms[term], self.dim)
        place = found.row * self.dim + bucket[found.term]
        out = np.bincount(place, found.count, len(texts) * self.dim).reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


class Retrying:
    """Repeat a provider call that raises, waiting longer each time."""

    def __init__(self, inner: Embedder, attempts: int = 3, delay: float = 1.0,
                 sleep: Callable[[float], None] = time.sleep) -> None:
        self.inner, self.attempts, self.delay, self.sleep = inner, attempts, delay, sleep
        self.dim = inner.dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.inner.embed(texts)
            except Exception as error:
                if attempt == self.attempts:
                    raise RuntimeError(f"embedding failed after {attempt} attempts: {error}") from error
                self.sleep(self.delay * attempt)
        raise AssertionError("unreachable")


def embed_text(text: str | None, embedder: Embedder | None = None) -> list[float]:
    """Vector of one query text; blank text is an error."""
    if not text or not text.strip():
        raise ValueError("text cannot be empty")
    return [float(v) for v in np.float32((embedder or WordHistogram()).embed([text])[0])]


def embedding(col: Column, embedder: Embedder | None = None) -> Column:
    """``array<float>`` per text; null for blank text, never shifted to a neighbour."""
    model = embedder or WordHistogram()

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        filled = [v for v in values if v and v.strip()]
        made = np.asarray(model.embed(filled), dtype=np.float32) if filled else np.zeros((0, model.dim), np.float32)
        sizes = [made.shape[1] if v and v.strip() else None for v in values]
        offsets = np.concatenate([[0], np.cumsum([s or 0 for s in sizes])]).astype(np.int32)
        empty = pa.array([s is None for s in sizes], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()), mask=empty)

    return run(col)


class Summarizer(Protocol):
    def chunk(self, content: Column) -> Column: ...

    def article(self, title: Column, content: Column) -> Column: ...


class LeadSentences:
    """The opening sentences of a text: two for a chunk, five for an article."""

    def __init__(self, chunk_sentences: int = 2, article_sentences: int = 5) -> None:
        self.chunk_sentences, self.article_sentences = chunk_sentences, article_sentences

    def chunk(self, content: Column) -> Column:
        return F.when(X.is_blank(content), F.lit("")).otherwise(X.lead(content, self.chunk_sentences))

    def article(self, title: Column, content: Column) -> Column:
        return F.when(X.is_blank(content), F.lit("")).otherwise(X.lead(content, self.article_sentences))


class GeneratedSummaries:
    """Summaries from a ``prompt -> text`` function, called inside tasks.

    A call that fails yields null, as one bad article must not stop a batch and
    must not look summarised.  ``max_input_chars`` is what the model can read.
    """

    def __init__(self, generate: Callable[[str], str], max_input_chars: int = C.ARTICLE_SUMMARY_INPUT_CHARS) -> None:
        self.generate, self.max_input_chars = generate, max_input_chars

    def _run(self, prompts: Column) -> Column:
        generate = self.generate

        @F.arrow_udf("string")
        def call(batch: pa.Array) -> pa.Array:
            def one(prompt):
                if not prompt:
                    return ""
                try:
                    return generate(prompt)
                except Exception:
                    return None

            return pa.array([one(p) for p in batch.to_pylist()], pa.string())

        return call(prompts)

    def chunk(self, content: Column) -> Column:
        prompt = F.concat(F.lit("Summarize in one or two sentences:\n\n"), content)
        return self._run(F.when(X.is_blank(content), F.lit("")).otherwise(prompt))

    def article(self, title: Column, content: Column) -> Column:
        shown = X.preview(content, self.max_input_chars)
        prompt = F.concat(F.lit("Summarize in three to five sentences.\nTitle: "), title, F.lit("\n\n"), shown)
        return self._run(F.when(X.is_blank(content), F.lit("")).otherwise(prompt))
