"""Sentence packing.

Packing is a left fold whose next boundary depends on where the last chunk was
cut, so no set-based operator expresses it.  It runs as one Arrow UDF per
batch: a document never leaves its task and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, functions as F

from newsloom import constants as C

_GAP = re.compile(r"\s+")
_BREAK = re.compile(r"(?<=[.!?。！？])\s+")


def chunk_spans(lengths: list[int], size: int, overlap: int) -> Iterator[tuple[int, int, bool]]:
    """Sentence ranges ``(first, last + 1, cut)`` of the chunks, in order.

    ``reach[j] - reach[i]`` is the room sentences ``i..j-1`` take with one blank
    each, so both the fill test and the overlap tail are differences of it.
    ``cut`` marks a sentence too long for a chunk, which gets windowed.
    """
    reach = [0, *accumulate(n + 1 for n in lengths)]
    first = 0
    for i, n in enumerate(lengths):
        if n > size:
            if first < i:
                yield first, i, False
            yield i, i + 1, True
            first = i + 1
        elif first < i and reach[i] - reach[first] + n > size:
            yield first, i, False
            tail = bisect_left(reach, reach[i] - 1 - overlap, first, i)
            first = max(first, tail)
    if first < len(lengths):
        yield first, len(lengths), False


def chunk_text(text: str | None, size: int, overlap: int) -> list[str]:
    """Overlapping chunks of a text; sizes are in characters."""
    flat = _GAP.sub(" ", (text or "").strip())
    parts = [s for s in (p.strip() for p in _BREAK.split(flat)) if s]
    chunks: list[str] = []
    for first, end, cut in chunk_spans([len(p) for p in parts], size, overlap):
        if cut:
            sentence = parts[first]
            chunks += [sentence[at:at + size] for at in range(0, len(sentence), size - overlap)]
        else:
            chunks.append(" ".join(parts[first:end]))
    return chunks


def chunks(col: Column, chunk_tokens: int | None = None, overlap_tokens: int | None = None) -> Column:
    """``array<string>`` of chunks; a size of 0 means "use the default"."""
    size = (chunk_tokens or C.CHUNK_TOKENS) * C.CHARS_PER_TOKEN
    overlap = (overlap_tokens or C.OVERLAP_TOKENS) * C.CHARS_PER_TOKEN

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([chunk_text(t.as_py(), size, overlap) for t in texts], pa.list_(pa.string()))

    return pack(col)
