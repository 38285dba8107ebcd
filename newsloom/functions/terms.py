"""Words of a batch of texts, found and counted in Arrow and numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from newsloom import constants as C

STOP_SET = frozenset(C.STOP_WORDS)


class BatchTerms:
    """Lower-cased runs of letters and digits without stop words.

    ``terms`` lists the different ones; ``row``, ``term`` and ``count`` say how
    often each occurs in each text, by text.
    """

    def __init__(self, texts: Sequence[str | None]):
        lowered = pa.array([(t or "").lower() for t in texts], pa.string())
        split = pc.split_pattern_regex(lowered, r"[^\pL\pN]+")
        found = split.flatten().dictionary_encode()
        self.terms = found.dictionary.to_pylist()
        code, offsets = found.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        usable = np.array([t != "" and t not in STOP_SET for t in self.terms], bool)
        kept = usable[code] if len(code) else np.zeros(0, bool)
        pairs, self.count = np.unique(row[kept] * max(len(self.terms), 1) + code[kept], return_counts=True)
        self.row, self.term = np.divmod(pairs, max(len(self.terms), 1))
