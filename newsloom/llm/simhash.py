"""Near duplicates by SimHash: tiled exact comparison of fingerprints.

Fingerprints are dealt into cells and cells into tiles of at most ``TILE_ROWS``.
Tasks compare pairs of tiles with exclusive-or and bit counts in numpy; pairs of
tiles that cannot hold a link are never formed.  Two ways to make cells:

* *population counts* of four quarters of the fingerprint.  Fingerprints within
  radius ``r`` have counts that differ by ``r`` or less in sum, so only tiles of
  neighbouring cells meet.
* *sizes* of the shingle sets, where a minimum similarity is asked: sets of
  similarity ``s`` have sizes within a factor ``s``.

The directory of cells is bounded by the number of possible cells, not by the
data.  A tile pair returns a spanning forest of its links, never all of them, so
a dense group of copies costs one row for each member.  Forests are joined by
alternating large-star and small-star steps over written tables.

Comparing all tiles is quadratic in the number of different fingerprints; the
cells lower the factor, not the power.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import map_arrow, small_batches, table, unused, utf8, written

TILE_ROWS = 8192
CHUNK_CELLS = 1 << 20       # cells of a comparison held at once
BLOCK_ROWS = 512            # texts of a candidate group compared in one task
BLOCK_BYTES = 8 << 20
RARITY_SLOTS = 1 << 18      # of the counts that order shingles; any order gives the same result
SKETCH_BITS = 6             # sketches bound how much two sets share before they are compared
SKETCH_SLOTS = 1 << SKETCH_BITS
PAIRS_AT_ONCE = 1 << 15     # sketches compared at once
SIZE_STEPS = 4              # size cells within one factor of 1 / similarity
MAX_SIZE_CELLS = 2048


# --- fingerprints -----------------------------------------------------------

def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles of a text, A-Z lower-cased; repeats stay, fewer words make one shingle."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1:] - 1).tolist())]


def majority(digests: bytes, n: int, size: int) -> bytes:
    """Bits set in over half of ``n`` digests of ``size`` bytes."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, size), axis=1)
    return np.packbits(np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > n).tobytes()


def fingerprint64(text: bytes, width: int) -> int:
    """SimHash of XXH64 (seed 42) over the shingles of a text, zero without words."""
    grams = shingles(text, width)
    if not grams:
        return 0
    digest = xxhash.xxh64_digest
    return int.from_bytes(majority(b"".join([digest(g, 42) for g in grams]), len(grams), 8), "big")


def fingerprint128(grams: list[bytes]) -> tuple[int, int]:
    if not grams:
        return 0, 0
    digest = xxhash.xxh3_128_digest
    made = majority(b"".join([digest(g, 42) for g in grams]), len(grams), 16)
    return int.from_bytes(made[:8], "big"), int.from_bytes(made[8:], "big")


def sketch(grams: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of ``SKETCH_SLOTS``, 255 and more as 255."""
    slots = np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH_SLOTS)
    return np.minimum(slots, 255).astype(np.uint8).tobytes()


def most_shared(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bound on what sets have in common by their sketches; 255 in both says nothing."""
    least = np.minimum(own, others)
    return np.where((least == 255).any(axis=-1), np.inf, least.sum(axis=-1, dtype=np.int64))


def gram_set(grams: list[bytes]) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp`` of every text."""
    def run(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"),
                   "fp": _signed([fingerprint64(t, width) for t in utf8(batch, "text")])}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


# --- tiles ------------------------------------------------------------------

def quarter_counts(fp: np.ndarray) -> np.ndarray:
    """Cell of 64-bit fingerprints: the population counts of their quarters, in base 17."""
    quarters = np.bitwise_count(fp.view(np.uint64).view(np.uint16).reshape(-1, 4)).astype(np.int64)
    return quarters @ np.array([1, 17, 289, 4913])


def count_neighbours(radius: int) -> list[tuple[int, ...]]:
    return [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]


class CountCells:
    """Cells by population counts; neighbours differ by ``radius`` at most in sum."""

    def __init__(self, radius: int):
        self.steps = np.array(count_neighbours(radius))

    def of(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return quarter_counts(columns["fp"])

    def near(self, cell: int) -> np.ndarray:
        own = np.array([cell // 17 ** i % 17 for i in range(4)])
        others = self.steps + own
        others = others[((others >= 0) & (others <= 16)).all(axis=1)]
        return others @ np.array([1, 17, 289, 4913])


class SizeCells:
    """Cells by the logarithm of a set's size; neighbours are within a factor ``similarity``."""

    def __init__(self, similarity: float):
        self.step = np.log(1 / similarity) / SIZE_STEPS

    def of(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return np.minimum(np.log(np.maximum(columns["size"], 1)) / self.step, MAX_SIZE_CELLS - 1).astype(np.int64)

    def near(self, cell: int) -> np.ndarray:
        return np.arange(cell - SIZE_STEPS - 1, cell + SIZE_STEPS + 2)


def tile_numbers(cells, counts: dict[int, int], tile_rows: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """For each cell: its first tile, how many it has, and all tiles it has to meet."""
    first, tiles, at = {}, {}, 0
    for cell in sorted(counts):
        first[cell], tiles[cell] = at, -(-counts[cell] // tile_rows)
        at += tiles[cell]
    return {cell: (first[cell], tiles[cell], np.concatenate(
        [np.arange(first[c], first[c] + tiles[c]) for c in cells.near(cell).tolist() if c in first])) for cell in counts}


def tile_pairs(items: DataFrame, cells, tile_rows: int, names: list[str]) -> DataFrame:
    """``items`` once for each pair of tiles it takes part in: ``lo, hi, tile`` and its columns.

    ``names`` are long columns of ``items``.  The directory that tasks receive
    has one entry for each cell that occurs: 17 ** 4 or ``MAX_SIZE_CELLS`` at most.
    """
    def counted(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_numpy() for n in names}
            cell, n = np.unique(cells.of(columns), return_counts=True)
            yield {"cell": cell, "n": n}

    found = map_arrow(items.select(*names), counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    directory = tile_numbers(cells, {r[0]: r[1] for r in found.collect()}, tile_rows)

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_numpy() for n in names}
            cell = cells.of(columns)
            mixed = columns[names[0]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            places = [directory[c] for c in cell.tolist()]
            first = np.array([p[0] for p in places])
            tile = first + (mixed % np.array([p[1] for p in places], np.uint64)).astype(np.int64)
            meets = [p[2] for p in places]
            take = np.repeat(np.arange(len(cell)), [len(m) for m in meets])
            tile, other = tile[take], np.concatenate(meets)
            yield {"lo": np.minimum(tile, other), "hi": np.maximum(tile, other), "tile": tile,
                   **{n: columns[n][take] for n in names}}

    schema = "lo long, hi long, tile long, " + ", ".join(f"{n} long" for n in names)
    return map_arrow(items.select(*names), dealt, schema)


# --- links ------------------------------------------------------------------

class Forest:
    """Union-find over array positions; the smaller position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        roots = {self.root(int(x)) for x in np.unique(self.parent[others])} | {self.root(i)}
        least = min(roots)
        for r in roots:
            self.parent[r] = least

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def near_rows(left: np.ndarray, right: np.ndarray, radius: int):
    """Rows of ``left`` with the rows of ``right`` within ``radius`` bits; both are (rows, words)."""
    step = max(1, CHUNK_CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        bits = sum(np.bitwise_count(left[at:at + step, None, w] ^ right[None, :, w]).astype(np.int16)
                   for w in range(left.shape[1])) if left.shape[1] > 1 else np.bitwise_count(
            left[at:at + step, None, 0] ^ right[None, :, 0])
        close = bits <= radius
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            yield at + i, np.flatnonzero(close[i])


def _runs(batches, keys: list[str]):
    """Rows of sorted batches, one group of equal ``keys`` after another, as numpy columns."""
    held: list[dict[str, np.ndarray]] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(columns[k][a] for k in keys)
            if key != now and held:
                yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            now = key
            held.append({n: c[a:b] for n, c in columns.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def tile_links(pairs: DataFrame, words: list[str], node: str, radius: int, similarity: float | None = None) -> DataFrame:
    """Spanning forests ``u, v`` of the links inside each pair of tiles."""
    def run(batches):
        us, vs = [], []
        for group in _runs(batches, ["lo", "hi"]):
            same = group["lo"][0] == group["hi"][0]
            inside = group["tile"] == group["lo"]
            if len(inside) < 2 or not (same or (inside.any() and not inside.all())):
                continue
            order = np.argsort(~inside, kind="stable")
            fps = np.stack([group[w].view(np.uint64)[order] for w in words], axis=1)
            nodes, cut = group[node][order], len(order) if same else int(inside.sum())
            forest, size = Forest(len(order)), group["size"][order] if similarity else None
            right = fps if same else fps[cut:]
            for i, others in near_rows(fps[:cut], right, radius):
                others = others if same else others + cut
                if similarity:
                    low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
                    others = others[low >= similarity * high - 1e-9]
                others = others[others != i]
                if len(others):
                    forest.join(i, others)
            roots = forest.roots()
            own = np.flatnonzero(roots != np.arange(len(roots)))
            us.append(nodes[own])
            vs.append(nodes[roots[own]])
            if sum(map(len, us)) > 50_000:
                yield {"u": np.concatenate(us), "v": np.concatenate(vs)}
                us, vs = [], []
        if us:
            yield {"u": np.concatenate(us), "v": np.concatenate(vs)}

    dealt = pairs.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return map_arrow(dealt, run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges (u, v)``: the smallest node each can reach.

    Large-star and small-star steps alternate until the edges are stars.  Every
    step writes its edges to the shared folder, so no lineage grows, and takes
    minima with partial aggregation, so a node with very many edges is no hot task.
    """
    def pairs(df):
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = written(pairs(edges), "links")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = written(pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))),
                        "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(pairs(small.unionByName(least.select("u", F.col("m").alias("v")))), "links")
        last, seen = seen, state(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- the operator -----------------------------------------------------------

def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    ``fp`` is the 64-bit SimHash of the text's word shingles.  Documents whose
    fingerprints differ by ``radius`` bits or less are linked, and
    ``component_id`` is the smallest id that links reach.  Null and empty texts
    have fingerprint zero and link like others.  Equal fingerprints are compared
    once.  A null id has a component, the null ids in it being passed over; a
    component of null ids only has a null id.  An empty table gives an empty
    result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    marked = written(with_fingerprints(docs, width), "fingerprints")
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "points")
    links = tile_links(tile_pairs(points, CountCells(radius), tile_rows, ["fp"]), ["fp"], "fp", radius)
    stars = components(links)
    joined = points.join(stars, points["fp"] == stars["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(joined.join(least, "root").select("fp", "component_id"), "point-components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 32,
                   tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id, keep_id`` of the documents with a near duplicate.

    Texts are near duplicates where the sets of their word shingles have a
    Jaccard similarity of ``similarity`` or more, and groups are closed under
    links.  128-bit fingerprints of the sets within ``radius`` propose groups (at
    0.8 the expected distance is 19 bits with a deviation of 4); the shingle sets
    of the members decide, block by block, with pairs that are already connected
    passed over.  Fingerprints prove nothing about the pairs they do not propose:
    those between different groups are found by their rarest shingles
    (:func:`_prefix_links`), so no link is lost.  ``doc_id`` must be unique; rows
    with a null id or no words stay alone.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")

    def marks(batches):
        for batch in batches:
            out = {"doc_id": [], "a": [], "b": [], "size": [], "sketch": []}
            for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
                grams = list(set(shingles(text, width)))
                if grams:
                    a, b = fingerprint128(grams)
                    for name, value in zip(out, (i, a, b, len(grams), sketch(gram_set(grams)))):
                        out[name].append(value)
            yield out | {"a": _signed(out["a"]), "b": _signed(out["b"])}

    marked = written(map_arrow(source, marks, "doc_id long, a long, b long, size long, sketch binary"), "marks")
    pairs = tile_pairs(marked, SizeCells(similarity), tile_rows, ["doc_id", "a", "b", "size"])
    proposed = components(tile_links(pairs, ["a", "b"], "doc_id", radius, similarity))
    members = written(proposed.select(F.col("node").alias("doc_id"), F.col("root").alias("group"))
                      .unionByName(proposed.select(F.col("root").alias("doc_id"), F.col("root").alias("group")))
                      .distinct(), "proposed")
    stars = components(written(_verified(source, members, width, radius, similarity), "verified"))
    more = _prefix_links(source, marked.select("doc_id", "sketch"), stars, width, similarity)
    found = components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def _verified(source: DataFrame, members: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """Links ``u, v`` that connect the members of each group as exact similarity does."""
    def sets(batches):
        for batch in batches:
            made = [list(set(shingles(t, width))) for t in utf8(batch, "text")]
            marks = [fingerprint128(m) for m in made]
            yield {"doc_id": batch.column("doc_id"), "group": batch.column("group"),
                   "a": _signed([m[0] for m in marks]), "b": _signed([m[1] for m in marks]),
                   "grams": [gram_set(m).tobytes() for m in made]}

    held = written(map_arrow(source.join(members, "doc_id"), sets,
                             "doc_id long, group long, a long, b long, grams binary"), "gram-sets")
    sizes = held.groupBy("group").agg(F.count("*").alias("n"), F.max(F.octet_length("grams")).alias("widest"))
    blocks = sizes.select("group", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS),
                                              F.ceil(F.col("n") * F.col("widest") / BLOCK_BYTES)).alias("blocks"))
    placed = (held.join(blocks, "group").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("group", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile",
                      "doc_id", "a", "b", "grams"))

    def run(batches):
        for group in _runs(batches, ["group", "lo", "hi"]):
            same = group["lo"][0] == group["hi"][0]
            order = np.argsort(group["doc_id"], kind="stable")
            ids, tile = group["doc_id"][order], group["tile"][order]
            grams = [np.frombuffer(g, np.uint64) for g in group["grams"][order]]
            fps = np.stack([group[w].view(np.uint64)[order] for w in ("a", "b")], axis=1)
            forest, size = Forest(len(ids)), np.array([len(g) for g in grams])
            us, vs = [], []
            for i, others in near_rows(fps, fps, radius):
                others = others[others < i]
                others = others[(np.minimum(size[i], size[others]) >= similarity * np.maximum(size[i], size[others]) - 1e-9)
                                & (same | (tile[others] != tile[i]))]
                for j in others.tolist():
                    if forest.root(i) == forest.root(j):
                        continue
                    both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                    if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                        forest.join(i, np.array([j]))
                        us.append(ids[i])
                        vs.append(ids[j])
            if us:
                yield {"u": us, "v": vs}

    dealt = placed.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    return map_arrow(dealt, run, "u long, v long")


def _rarity(source: DataFrame, width: int) -> np.ndarray:
    """Counts of the shingles of all documents by hash slot."""
    def run(batches):
        total = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            for text in utf8(batch, "text"):
                np.add.at(total, gram_set(shingles(text, width)) % np.uint64(RARITY_SLOTS), 1)
        slot = np.flatnonzero(total)
        yield {"slot": slot, "n": total[slot]}

    slots = map_arrow(source.select("text"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(RARITY_SLOTS, np.int64)
    counts[slots["slot"].to_numpy(int)] = slots["n"].to_numpy(np.int64)
    return counts


def _prefixes(source: DataFrame, width: int, similarity: float) -> DataFrame:
    """``key, doc_id, size, pos``: of every set of n shingles the n - ceil(similarity * n) + 1 rarest.

    Two sets of that similarity have one of these in common, whatever the order,
    so long as all sets are put in the same one.  Rare shingles first keeps the
    number of sets that meet under a key low.
    """
    counts = source.sparkSession.sparkContext.broadcast(_rarity(source, width))  # RARITY_SLOTS numbers

    def run(batches):
        for batch in batches:
            out = {"key": [], "doc_id": [], "size": [], "pos": []}
            for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
                grams = gram_set(shingles(text, width))
                n = len(grams)
                if n:
                    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
                    order = np.lexsort((grams, counts.value[grams % np.uint64(RARITY_SLOTS)]))[:most]
                    for name, value in zip(out, (grams[order].view(np.int64), np.full(len(order), i),
                                                 np.full(len(order), n), np.arange(len(order)))):
                        out[name].append(value)
            if out["key"]:
                yield {name: np.concatenate(parts) for name, parts in out.items()}

    return map_arrow(source, run, "key long, doc_id long, size int, pos int")


def _prefix_links(source: DataFrame, sketches: DataFrame, stars: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``u, v`` between documents that ``stars (node, root)`` leaves apart, by exact similarity.

    A key whose documents are all in one group is dropped, so a dense group of
    copies forms no pairs; a key of very many others is dealt out in blocks.
    """
    rows = written(_prefixes(source, width, similarity), "prefixes")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rooted = written(rows.join(often, "key").join(stars, F.col("doc_id") == F.col("node"), "left").select(
        "key", "doc_id", "size", "pos", F.coalesce("root", "doc_id").alias("root")), "prefixes-met")
    apart = (rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
             .filter("least < most").select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")))
    placed = (rooted.join(apart, "key").join(sketches, "doc_id").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile",
                      "doc_id", "size", "pos", "root", "sketch"))

    def close(groups):
        """Pairs of several groups that may be similar, the lower id first."""
        rows = {n: np.concatenate([g[n] for g in groups]) for n in ("doc_id", "tile", "root", "size", "pos", "lo", "hi")}
        held = np.frombuffer(b"".join(b"".join(g["sketch"]) for g in groups), np.uint8).reshape(-1, SKETCH_SLOTS)
        last = np.repeat(np.cumsum([len(g["key"]) for g in groups]), [len(g["key"]) for g in groups])
        later = last - np.arange(len(last)) - 1
        i = np.repeat(np.arange(len(last)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        size = rows["size"].astype(np.int64)
        left, wanted = size - rows["pos"], similarity * (size[i] + size[j]) - 1e-9
        # at the first shingle two sets share, what is left of the shorter rest bounds their overlap
        near = ((rows["root"][i] != rows["root"][j]) & ((rows["lo"] == rows["hi"])[i] | (rows["tile"][i] != rows["tile"][j]))
                & ((1 + similarity) * np.minimum(left[i], left[j]) >= wanted))
        i, j, wanted = i[near], j[near], wanted[near]
        # a sketch bounds the overlap of the whole sets: a passage that many share is no pair
        near = np.concatenate([(1 + similarity) * most_shared(held[i[k:k + PAIRS_AT_ONCE]], held[j[k:k + PAIRS_AT_ONCE]])
                               for k in range(0, len(i), PAIRS_AT_ONCE)] or [wanted]) >= wanted
        u, v = rows["doc_id"][i[near]], rows["doc_id"][j[near]]
        return np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0).T

    def meet(batches):
        groups, pairs = [], 0
        for group in _runs(batches, ["key", "lo", "hi"]):
            groups.append(group)
            pairs += len(group["key"]) ** 2
            if pairs > 1 << 18:
                u, v = close(groups)
                groups, pairs = [], 0
                yield {"u": u, "v": v}
        if groups:
            u, v = close(groups)
            yield {"u": u, "v": v}

    dealt = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = written(map_arrow(dealt, meet, "u long, v long").distinct(), "prefix-pairs")

    def sets(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"),
                   "grams": [gram_set(shingles(t, width)).tobytes() for t in utf8(batch, "text")]}

    ends = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    held = written(map_arrow(source.join(ends, "doc_id"), sets, "doc_id long, grams binary"), "prefix-sets")
    both = (pairs.join(held.select(F.col("doc_id").alias("u"), F.col("grams").alias("a")), "u")
            .join(held.select(F.col("doc_id").alias("v"), F.col("grams").alias("b")), "v"))

    def decide(batches):
        for batch in batches:
            a, b = ([np.frombuffer(g, np.uint64) for g in batch.column(n).to_pylist()] for n in ("a", "b"))
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], float)
            sizes = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
            near = shared >= similarity * (sizes - shared) - 1e-9
            yield {n: batch.column(n).to_numpy()[near] for n in ("u", "v")}

    return written(map_arrow(both, decide, "u long, v long"), "prefix-links")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of near duplicates.

    Rows that repeat an id are told apart by numbers beyond all ids; rows with a null
    id and texts without words stay.  Columns of any name pass through; an empty
    table stays empty.
    """
    gone_id, row = unused(docs, "gone_id"), unused(docs, "_row")
    often = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
                    .select("doc_id"), "near-repeated-ids")
    if often.isEmpty():
        gone = written(similar_groups(docs).select(F.col("doc_id").alias(gone_id)), "near-gone")
        return docs.join(gone, docs["doc_id"] == F.col(gone_id), "left_anti")
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    again = written(docs.join(often, "doc_id", "left_semi").withColumn(
        row, F.monotonically_increasing_id() + F.lit(top + 1)), "near-repeated")
    rows = docs.join(often, "doc_id", "left_anti").withColumn(row, F.col("doc_id").cast("long")).unionByName(again)
    found = written(similar_groups(rows.select(F.col(row).alias("doc_id"), "text")), "near-groups")
    members = found.unionByName(found.select(F.col("keep_id").alias("doc_id"), "keep_id").distinct()).select(
        F.col("doc_id").alias(row), F.col("keep_id").alias("group"))
    members = members.join(again.select(row, F.col("doc_id").cast("long").alias("id")), row, "left").select(
        row, "group", F.coalesce("id", row).alias("id"))
    stays = members.groupBy("group").agg(F.min(F.struct("id", row)).alias("first"))
    gone = written(members.join(stays, "group").filter(F.col(row) != F.col(f"first.{row}")).select(row), "near-gone")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
