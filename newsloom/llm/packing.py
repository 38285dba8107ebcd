"""Packing documents into sequences of a fixed number of tokens.

The plan is made on the histogram of piece lengths, which has at most
``max_tokens`` entries whatever the corpus.  A configuration is a multiset of
lengths that fits one sequence; the linear program over configurations asks for
the fewest sequences that cover the histogram.  Multiplicative weights solve it:
every round a knapsack dynamic program prices the best configuration under the
current weights and the weights of what it covers shrink.  Fractional counts are
rounded down and realised with the lengths at hand, whole multiplicities at a
time, and what is left is packed by best fit.

The pieces themselves never meet: a piece finds its place from its rank among
the pieces of its length, and ranks come from counts by task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.base import Batches, map_arrow, small_batches, table, written

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
END_OF_TEXT = 0
PART_CACHE = 260_000        # parts whose ids a worker remembers from batch to batch,
CACHE_BYTES = 32 << 20      # and the bytes of these and their ids
#: What the vocabulary's pattern makes of ASCII bytes: runs of letters, single digits, runs of signs; 0 needs its word.
LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.array([LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN if 32 < c < 127 and c != ord("'") else 0
                 for c in range(128)] + [0] * 128, np.uint8)

GROUPS = 48                 # length classes of the linear program
ROUNDS = 1500               # of multiplicative weights
STEP = 0.15
ROUNDED = 0.9               # share of a fractional count that is realised before best fit takes the rest


# --- tokens -----------------------------------------------------------------

class WordTokens:
    """Token ids of whole texts, found part by part.

    The vocabulary's pattern never joins characters across white space and cuts a
    word of plain letters, digits and signs where their kind changes, so the ids
    of a text are those of its parts in order.  Other words are one part.  Parts
    repeat more than words do: those of a batch's different words are looked up
    among the parts met before, and the ids of the batch are gathered from theirs.
    New parts are encoded many to a call; one of a single kind ends with the first
    id that has the vocabulary's word end.  ASCII parts, in lower case and cut by
    now, need the vocabulary's merges only, not what it does to a text before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        # known parts, the bytes of their ids and the batch that met them last; Arrow holds them in a tenth of a dictionary's memory
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.met, self.batches = np.zeros(0, np.int32), 0

    def encoded(self, text: str, merges_only: bool = False) -> np.ndarray:
        by = self.merges if merges_only else self.tokenizer
        return np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, parts: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Append ``parts``, none of them known, with their ids; returns their places."""
        kept, odd = [], parts.filter(pa.array(~plain)).to_pylist()
        ids, sizes = [], []
        ascii = pc.string_is_ascii(parts).to_numpy(zero_copy_only=False)
        for chosen, merges_only in ((plain & ascii, True), (plain & ~ascii, False)):
            cut = parts.filter(pa.array(chosen)).to_pylist()
            for at in range(0, len(cut), 200):
                some = cut[at:at + 200]
                made = self.encoded(" ".join(some), merges_only)
                last = np.flatnonzero(self.ends[made]) + 1
                if len(last) == len(some):
                    ids.append(made)
                    sizes.append(np.diff(last, prepend=0))
                    kept += some
                else:
                    odd += some
        for part in odd:
            ids.append(self.encoded(part))
            sizes.append([len(ids[-1])])
        added, reached = pa.array(kept + odd, pa.string()), len(self.known)
        self.known = pa.concat_arrays([self.known, added])
        self.ids = pa.concat_arrays([self.ids, _values(np.concatenate(ids).astype("<u4"), np.concatenate(sizes) * 4)])
        self.met = np.concatenate((self.met, np.zeros(len(added), np.int32)))
        return reached + _places(parts, added)

    def forget(self) -> None:
        """Keep the parts met last, up to three quarters of what the bounds allow."""
        newest = np.argsort(-self.met, kind="stable")
        size = pc.add(pc.binary_length(self.ids), pc.cast(pc.binary_length(self.known), pa.int64())).to_numpy()
        room = np.searchsorted(np.cumsum(size[newest]), CACHE_BYTES * 3 // 4, "right")
        kept = np.sort(newest[:min(room, PART_CACHE * 3 // 4)])
        self.met = self.met[kept]
        self.known, self.ids = self.known.take(pa.array(kept)), self.ids.take(pa.array(kept))

    def of_words(self, words: pa.Array) -> pa.Array:
        """The bytes of the ids of each word."""
        parts, first, plain = _parts(words)
        found = parts.dictionary_encode()
        code = found.indices.to_numpy()
        place = _places(found.dictionary, self.known)
        new = place < 0
        if new.any():
            is_plain = np.zeros(len(place), bool)
            is_plain[code] = plain
            place[new] = self.learn(found.dictionary.filter(pa.array(new)), is_plain[new])
        self.batches += 1
        self.met[place] = self.batches
        made = self.ids.take(pa.array(place[code]))
        if len(self.known) > PART_CACHE or self.known.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.forget()
        if not len(made):
            return pa.array([b""] * len(words), pa.large_binary())
        _, at, ids = made.buffers()
        at = np.frombuffer(at, np.int64)[made.offset:made.offset + len(made) + 1][first]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), ids])

    def packed(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null as empty."""
        # the vocabulary lower-cases as well, but looks for its special tokens before that
        texts = texts.fill_null("")
        marked = pc.match_substring(texts, "<|")
        special = {k: text for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist()
                   if any(s in (text := texts[k].as_py()).lower() for s in self.special)}
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        del split
        made = self.of_words(found.dictionary).take(found.indices)
        if not len(made):
            return [np.zeros(0, np.uint32)] * len(texts)
        _, at, ids = made.buffers()
        bounds = (np.frombuffer(at, np.int64)[made.offset + offsets] // 4).tolist()
        ids = np.frombuffer(ids, "<u4") if ids else np.zeros(0, np.uint32)
        return [self.encoded(special[k]) if k in special else ids[a:b] for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def _parts(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts of all words one after another, which are each word's (``first[k]`` to ``first[k + 1]``) and which are of one kind."""
    _, at, text = words.buffers()
    at = np.frombuffer(at, np.int32)[words.offset:words.offset + len(words) + 1]
    start, text = int(at[0]), text or pa.py_buffer(b"")
    at = at - start
    data = np.frombuffer(text, np.uint8)[start:start + int(at[-1])]
    kind = KIND[data]
    # two bytes of a Latin letter from U+00C0 on, other than the signs for times and division
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] & 0xDF) != 0x97]
    kind[lead] = kind[lead + 1] = LETTER
    edge = np.empty(len(data), bool)
    edge[:1] = True
    edge[1:] = kind[1:] != kind[:-1]
    edge |= kind == DIGIT
    odd = np.searchsorted(at, np.flatnonzero(kind == 0), "right") - 1
    if len(odd):
        whole = np.zeros(len(words), bool)
        whole[odd] = True
        edge &= ~np.repeat(whole, np.diff(at))
    edge[at[:-1][at[1:] > at[:-1]]] = True
    begin = np.flatnonzero(edge)
    ends = np.append(begin, len(data)).astype(np.int32)
    first = np.searchsorted(begin, at)
    parts = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(ends + np.int32(start)), text])
    plain = np.ones(len(begin), bool)
    plain[first[odd]] = False
    return parts, first, plain


def _values(content: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given sizes in bytes, one after another in ``content``."""
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(content)])


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is among others, -1 if nowhere."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy().copy()


_TOKENS: dict[str, WordTokens] = {}


def _cut(batches: Batches, path: str, max_tokens: int) -> Iterator[dict[str, list]]:
    """Columns of :func:`token_pieces` for each batch of ``doc_id, text``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    # threads per word cost more than they gain, and Spark has a task on every core
    tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, WordTokens(path))
    end = np.array([END_OF_TEXT], np.uint32)
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
        if not batch.num_rows:
            continue
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.packed(batch.column("text"))):
            ids = np.concatenate((ids, end))
            for piece, at in enumerate(range(0, len(ids), max_tokens)):
                part = ids[at:at + max_tokens]
                for name, value in zip(out, (doc_id, piece, at, len(part), part.astype("<u4").tobytes())):
                    out[name].append(value)
        yield out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def token_pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the texts as token ids and an end mark, long ones cut.

    ``ids`` packs unsigned 32-bit little-endian ids.  Null and empty texts are
    the end mark alone.
    """
    def run(batches):
        return _cut(batches, path, max_tokens)

    return map_arrow(_texts(docs), run, "doc_id long, piece int, start long, length long, ids binary")


# --- the plan ---------------------------------------------------------------

def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size for the greatest value within ``capacity``.

    Unbounded knapsack by dynamic programming over the capacity: each size is
    offered in powers of two of copies.
    """
    best = np.zeros(capacity + 1)
    offers = []
    for k, (value, size) in enumerate(zip(values.tolist(), sizes.tolist())):
        copies = 1
        while copies * size <= capacity:
            offers.append((k, copies, copies * size, copies * value))
            copies *= 2
    taken = np.zeros((len(offers), capacity + 1), bool)
    for at, (_, _, size, value) in enumerate(offers):
        with_it = best[:-size] + value
        better = with_it > best[size:] + 1e-15
        taken[at, size:] = better
        best[size:] = np.where(better, with_it, best[size:])
    counts, room = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for at in range(len(offers) - 1, -1, -1):
        if taken[at, room]:
            k, copies, size, _ = offers[at]
            counts[k] += copies
            room -= size
    return counts


def length_groups(histogram: dict[int, int], groups: int) -> list[list[int]]:
    """Consecutive lengths, longest first, in groups of about equal token totals."""
    total = sum(length * n for length, n in histogram.items())
    made: list[list[int]] = [[]]
    held = 0
    for length in sorted(histogram, reverse=True):
        if made[-1] and held >= total * len(made) / groups:
            made.append([])
        made[-1].append(length)
        held += length * histogram[length]
    return made


def fractional(groups: list[list[int]], histogram: dict[int, int], capacity: int,
               rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations over the groups with fractional counts that cover the histogram.

    A group is priced at its longest length, so any of its lengths fits.
    Weights start at the token mass of the groups.
    """
    sizes = np.array([g[0] for g in groups])
    demand = np.array([sum(histogram[x] for x in g) for g in groups], float)
    weights = demand * sizes / (demand * sizes).sum()
    covered = np.zeros(len(groups))
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        config = knapsack(weights / demand, sizes, capacity)
        used = config > 0
        if not used.any():
            break
        times = (demand[used] / config[used]).min()
        share = config * times / demand
        covered += share
        weights *= np.exp(-STEP * share)
        weights /= weights.sum()
        entry = found.setdefault(config.tobytes(), [config, 0.0])
        entry[1] += times
        if covered.min() > 40:
            break
    scale = max(covered.min(), 1e-9)
    if scale < 1e-6:
        scale = float(np.median(covered[covered > 0]))
    return sorted(((c, x / scale) for c, x in found.values()), key=lambda e: -e[1])


class Stock:
    """Lengths still to place, with their counts."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: n for k, n in histogram.items() if n}
        self.order = sorted(self.left)

    def most(self, limit: int, used: dict[int, int], least: int = 1) -> int | None:
        """The longest length up to ``limit`` that is left beside ``used``."""
        at = bisect_right(self.order, limit)
        while at:
            length = self.order[at - 1]
            if length < least:
                return None
            if self.left[length] > used.get(length, 0):
                return length
            at -= 1
        return None

    def take(self, config: list[int], times: int) -> None:
        for length in config:
            self.left[length] -= times
        for length in set(config):
            if not self.left[length]:
                del self.left[length]
                self.order.remove(length)

    def fill(self, config: list[int], room: int, used: dict[int, int]) -> None:
        """Best fit: the longest length that still fits, again and again."""
        while room and (length := self.most(room, used)):
            config.append(length)
            used[length] = used.get(length, 0) + 1
            room -= length

    def realised(self, slots: list[list[int]], capacity: int) -> tuple[list[int], dict[int, int]]:
        """A configuration of classes as lengths at hand: the longest of each class, the last slot by best fit.

        Empty if a class has run out.
        """
        config, used, room = [], {}, capacity
        for members in slots[:-1]:
            length = self.most(members[0], used, members[-1])
            if length is None:
                return [], used
            config.append(length)
            used[length] = used.get(length, 0) + 1
            room -= length
        self.fill(config, room, used)
        return config, used

    def times(self, used: dict[int, int]) -> int:
        return min(self.left[length] // n for length, n in used.items())


def plan(histogram: dict[int, int], capacity: int = MAX_TOKENS, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """Configurations of lengths and how many sequences get each; together they use up the histogram."""
    stock, made = Stock(histogram), []
    if not stock.left:
        return []
    classes = length_groups(stock.left, groups)
    for counts, x in fractional(classes, dict(stock.left), capacity):
        wanted = int(x * ROUNDED)
        slots = [classes[k] for k in np.flatnonzero(counts).tolist() for _ in range(int(counts[k]))]
        while wanted:
            config, used = stock.realised(slots, capacity)
            if sum(config) < capacity:
                break  # a gap that best fit may close later
            times = min(wanted, stock.times(used))
            made.append((config, times))
            stock.take(config, times)
            wanted -= times
    while stock.left:
        config, used = [], {}
        stock.fill(config, capacity, used)
        times = stock.times(used)
        made.append((config, times))
        stock.take(config, times)
    return made


def places(made: list[tuple[list[int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length: from which rank on which sequence and offset follow.

    The piece of rank ``r`` among its length goes to the last entry that starts
    at ``r`` or before, to sequence ``first + r - start``.
    """
    slots: dict[int, list[tuple[int, int, int]]] = {}
    reached: dict[int, int] = {}
    sequence = 0
    for config, times in made:
        offset = 0
        for length in config:
            start = reached.get(length, 0)
            slots.setdefault(length, []).append((start, sequence, offset))
            reached[length] = start + times
            offset += length
        sequence += times
    return {length: dict(zip(("start", "first", "offset"), np.array(rows, np.int64).T)) for length, rows in slots.items()}


# --- the operator -----------------------------------------------------------

class Ranks:
    """Ranks of a task's pieces among those of their length, in the order they come."""

    def __init__(self, max_tokens: int):
        self.reached = np.zeros(max_tokens + 1, np.int64)

    def of(self, lengths: np.ndarray) -> np.ndarray:
        if lengths.size and (lengths.min() < 1 or lengths.max() >= len(self.reached)):
            raise ValueError(f"a piece is empty or longer than {len(self.reached) - 1} tokens")
        order = np.argsort(lengths, kind="stable")
        found, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
        within = np.arange(len(lengths)) - np.repeat(starts, counts)
        rank = np.empty(len(lengths), np.int64)
        rank[order] = within + np.repeat(self.reached[found], counts)
        self.reached[found] += counts
        return rank


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``max_tokens``) with ``sequence_id`` and ``offset``.

    Offsets of a sequence run from 0 without gaps and stay within ``max_tokens``.
    Rows of null or other lengths are an error.  ``pieces`` is written once; an
    empty table gives an empty result.  Columns named ``_task`` or ``_rank`` may
    not occur.
    """
    names = pieces.columns

    def ranked(batches):
        task, ranks = TaskContext.get().partitionId(), Ranks(max_tokens)
        for batch in batches:
            rank = ranks.of(batch.column("length").to_numpy())
            yield {n: batch.column(n) for n in names} | {"_task": np.full(len(rank), task), "_rank": rank}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", _task int, _rank long"
    return _placed(written(map_arrow(pieces, ranked, schema), "pieces"), max_tokens)


def _placed(held: DataFrame, max_tokens: int) -> DataFrame:
    """Stored pieces with ``_task`` and ``_rank``, at their places instead."""
    kinds = {f.name: f.dataType.simpleString() for f in held.schema if f.name not in ("_task", "_rank")}
    names = list(kinds)
    by_task = held.groupBy("length", "_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(by_task.select("length", "_task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")),
                   "piece-ranks")
    histogram = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("n")).collect()}
    slots = places(plan(histogram, max_tokens))

    def placed(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            rank = batch.column("_base").to_numpy() + batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for length in np.unique(lengths).tolist():
                own, slot = np.flatnonzero(lengths == length), slots[length]
                at = np.searchsorted(slot["start"], rank[own], "right") - 1
                sequence[own] = slot["first"][at] + rank[own] - slot["start"][at]
                offset[own] = slot["offset"][at]
            yield {n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": offset}

    schema = ", ".join(f"`{n}` {kind}" for n, kind in kinds.items())
    joined = held.join(base.drop("n"), ["length", "_task"]).select(*names, "_rank", "_base")
    return map_arrow(joined, placed, schema + ", sequence_id long, `offset` long")


def packed_documents(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces of ``docs`` with the crc32 of their ids, packed.

    Rows that repeat an id are documents of their own.  Columns other than
    ``doc_id`` and ``text`` are not looked at.
    """
    import public_tokenizers

    # looking the known words up costs the same for a small batch as for a larger one
    small_batches(docs.sparkSession, rows=1000, size="4m")
    path = path or public_tokenizers.path(TOKENIZER)

    # cut, summed and ranked in one pass: a second Python stage would be a second worker beside each task
    def run(batches):
        task, ranks = TaskContext.get().partitionId(), Ranks(max_tokens)
        for found in _cut(batches, path, max_tokens):
            rank = ranks.of(np.array(found["length"], np.int64))
            yield found | {"ids_crc32": [zlib.crc32(ids) for ids in found["ids"]], "_task": np.full(len(rank), task), "_rank": rank}

    held = map_arrow(_texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long")
    return _placed(written(held, "pieces"), max_tokens)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
