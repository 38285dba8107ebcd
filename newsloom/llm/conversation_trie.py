"""Prefix trie of rebuilt conversations over sorted shards.

A rebuilt conversation is a path: 16 bytes of digest for each turn, so that the order
of the byte strings is the order of turn sequences.  Splitters taken from a small
sample deal the paths over shards; a node whose conversations lie in several shards is
a prefix of a splitter.  These prefixes, the skeleton, are sent to every task.  Each
shard, sorted, is walked once with a stack: nodes outside the skeleton are finished
there, skeleton nodes leave one partial row a shard, which are reduced and then summed
over the skeleton from the bottom.

Of a splitter only the first ``SPLITTER_TURNS`` turns are kept, so the skeleton has at
most shards x ``SPLITTER_TURNS`` nodes whatever the data.  Equal paths are split by id:
a conversation that a third of all others repeats is spread like any other.  A shard
row is one conversation (20 bytes a turn), texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import Batches, map_arrow, small_batches, table, written

KEY_BYTES = 16
SPLITTER_TURNS = 64
#: Sampled paths for each shard; the sample settles only how evenly shards are filled.
SAMPLED = 32

# --- fixed values: how conversations are rebuilt
BLOCK, MOST_SHARED = 5, 9
NO_ENDS = hashlib.sha256(b"").hexdigest()

Splitter = tuple[bytes, int]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order as (known, turn, role, key, size)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    lines = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(
        F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"),
        F.substring(F.sha2(whole, 256), 1, 2 * KEY_BYTES).alias("key"), F.octet_length(text).alias("size")).alias("line"))
    return lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("line")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of every conversation after its first turns are those of its block's head."""
    own = turns(conversations)
    heads = (own.filter(F.col("conv_id") % BLOCK == 0)
             .select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, MOST_SHARED - 1).alias("head")))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    none = F.slice("turns", 1, 0)
    both = (own.withColumn("shared", shared).join(heads, F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("head_id"), "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("shared")),
                                        F.slice("turns", F.col("shared") + 1, F.size("turns"))).alias("turns")))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
                       F.transform("turns", lambda t: t["size"]).alias("sizes"))


def splitters(paths: DataFrame, shards: int) -> list[Splitter]:
    """At most ``shards`` - 1 (path, id) that cut the sorted paths into parts of about equally many turns."""
    n = paths.count()
    if shards < 2 or n < 2:
        return []
    sample = paths.sample(min(1.0, SAMPLED * shards / n), seed=1).select(
        F.substring("path", 1, SPLITTER_TURNS * KEY_BYTES).alias("path"), "conv_id", F.size("sizes").alias("n")).collect()
    sample = sorted((bytes(r.path), r.conv_id, r.n + 1) for r in sample)
    total, done, cuts = sum(r[2] for r in sample), 0, []
    for path, conv, size in sample:
        if done * shards >= total * (len(cuts) + 1) and len(cuts) < shards - 1:
            cuts.append((path, conv))
        done += size
    return sorted(set(cuts))


class Skeleton:
    """Prefixes of the splitters, the root first and every node behind its parent."""

    def __init__(self, cuts: list[Splitter]):
        prefixes = {path[:d] for path, _ in cuts for d in range(0, len(path) + 1, KEY_BYTES)} | {b""}
        self.paths = sorted(prefixes, key=lambda p: (len(p), p))
        self.number = {p: k for k, p in enumerate(self.paths)}
        self.parent = [-1] + [self.number[p[:-KEY_BYTES]] for p in self.paths[1:]]


def ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() if ids else NO_ENDS


class Node:
    __slots__ = ("number", "size", "least", "members", "children", "leaves", "saved", "ends", "below")

    def __init__(self, number: int, size: int):
        self.number, self.size = number, size  # place in the skeleton, -1 outside it
        self.least, self.members = None, 0
        self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.below: list[list] = []            # finished children, which lack their parent's least member

    def take(self, other: Node) -> None:
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.members += other.members
        self.leaves += other.leaves
        self.saved += other.saved


#: Rows of a shard.  ``node``: all is known but, where ``above`` is not null, the parent's least member.
#: ``part``: what the shard knows of skeleton node ``number``.  ``end``: the ids that end at ``number`` in shard ``above``.
SHARD = ("kind string, number int, above int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string, size long")
COLUMNS = [c.strip().split()[0] for c in SHARD.split(",")]


class Walk:
    """Depth-first walk over the sorted paths of one shard."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton, self.out = shard, skeleton, []
        self.path, self.open = b"", [Node(0, 0)]

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        self.close(self._shared(path))
        for depth in range(len(self.open), len(path) // KEY_BYTES + 1):
            number = -1
            if self.open[-1].number >= 0:
                number = self.skeleton.number.get(path[:depth * KEY_BYTES], -1)
            self.open.append(Node(number, sizes[depth - 1]))
        last = self.open[-1]
        last.ends.append(conv)
        last.members += 1
        last.least = conv if last.least is None else min(last.least, conv)
        self.path = path

    def _shared(self, path: bytes) -> int:
        """Number of turns ``path`` has in common with the last one."""
        low, high = 0, min(len(path), len(self.path)) // KEY_BYTES
        while low < high:
            middle = (low + high + 1) // 2
            at = middle * KEY_BYTES
            low, high = (middle, high) if path[low * KEY_BYTES:at] == self.path[low * KEY_BYTES:at] else (low, middle - 1)
        return low

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than ``depth``."""
        while len(self.open) > depth + 1:
            node, up = self.open.pop(), self.open[-1]
            if node.number >= 0:
                self._part(node)
            else:
                node.leaves = node.leaves if node.children else 1
                node.saved += (node.members - 1) * node.size
                row = ["node", None, None, node.least, len(self.open), None, node.members, node.children, node.leaves,
                       node.saved, ends_digest(node.ends), None]
                self._name_parent(node)
                if up.number >= 0:
                    row[2] = up.number
                    self.out.append(row)
                else:
                    up.below.append(row)
                up.children += 1
            up.take(node)

    def _name_parent(self, node: Node) -> None:
        for row in node.below:
            row[5] = node.least
        self.out.extend(node.below)

    def _part(self, node: Node) -> None:
        self.out.append(["part", node.number, None, node.least, None, None, node.members, node.children, node.leaves, node.saved,
                         None, node.size])
        if node.ends:
            self.out.append(["end", node.number, self.shard, *[None] * 7, ",".join(map(str, node.ends)), None])

    def finish(self) -> None:
        self.close(0)
        if self.open[0].members:
            self._part(self.open[0])

    def taken(self) -> dict:
        rows, self.out = self.out, []
        return dict(zip(COLUMNS, map(list, zip(*rows))))


def shard_rows(paths: DataFrame, cuts: list[Splitter], skeleton: Skeleton, shards: int) -> DataFrame:
    """:data:`SHARD` rows of all shards."""
    known = paths.sparkSession.sparkContext.broadcast((cuts, skeleton))

    def deal(batches: Batches) -> Iterator[dict]:
        cuts, _ = known.value
        for batch in batches:
            path, conv = batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()
            yield {"shard": [bisect_right(cuts, p) for p in zip(path, conv)], "conv_id": conv, "path": path,
                   "sizes": batch.column("sizes")}

    def walk(batches: Batches) -> Iterator[dict]:
        at, walker = None, None
        for batch in batches:
            for shard, path, conv, sizes in zip(*(batch.column(n).to_pylist() for n in ("shard", "path", "conv_id", "sizes"))):
                if shard != at:
                    if walker:
                        walker.finish()
                    done, at, walker = walker, shard, Walk(shard, known.value[1])
                    if done and done.out:
                        yield done.taken()
                walker.add(path, conv, sizes)
                if len(walker.out) >= 20_000:
                    yield walker.taken()
        if walker:
            walker.finish()
            yield walker.taken()

    dealt = map_arrow(paths, deal, "shard int, conv_id long, path binary, sizes array<int>")
    ordered = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return written(map_arrow(ordered, walk, SHARD), "trie-shards")


def skeleton_rows(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished skeleton nodes: ``number`` and the result's columns."""
    spark = rows.sparkSession
    of = rows.filter(F.col("kind") == "part").groupBy("number").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("size").alias("size"))
    parts = {r.number: r for r in of.collect()}  # one row a skeleton node
    children = {k: p.children for k, p in parts.items()}
    for k in parts:
        if skeleton.parent[k] >= 0:
            children[skeleton.parent[k]] += 1
    # the shards' sums hold everything but what the skeleton's own nodes add
    leaves, saved = dict.fromkeys(parts, 0), dict.fromkeys(parts, 0)
    for k in sorted(parts, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (parts[k].members - 1) * parts[k].size
        if skeleton.parent[k] >= 0:
            leaves[skeleton.parent[k]] += leaves[k]
            saved[skeleton.parent[k]] += saved[k]
    data = [(k, p.least, len(skeleton.paths[k]) // KEY_BYTES, parts[skeleton.parent[k]].least if k else None, p.members, children[k],
             p.leaves + leaves[k], p.saved + saved[k]) for k, p in parts.items()]
    nodes = spark.createDataFrame(data, "number int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                        "n_leaves long, saved_tokens long")

    def digests(batches: Batches) -> Iterator[dict]:
        at, sha = None, None
        for batch in batches:
            for number, ids in zip(batch.column("number").to_pylist(), batch.column("ids").to_pylist()):
                if number != at:
                    if sha:
                        yield {"number": [at], "ends_sha256": [sha.hexdigest()]}
                    at, sha = number, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            yield {"number": [at], "ends_sha256": [sha.hexdigest()]}

    # equal paths are dealt over shards by id, so the ids of a node rise from shard to shard
    ends = (rows.filter(F.col("kind") == "end").select("number", "above", F.col("ends_sha256").alias("ids"))
            .repartition("number").sortWithinPartitions("number", "above"))
    known = map_arrow(ends, digests, "number int, ends_sha256 string")
    return nodes.join(known, "number", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the trie of ``paths (conv_id, path, sizes)``; no rows without paths."""
    shards = shards or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(paths, shards)
    skeleton = Skeleton(cuts)
    rows = shard_rows(paths, cuts, skeleton, shards)
    top = written(skeleton_rows(rows, skeleton), "trie-skeleton")
    nodes = rows.filter(F.col("kind") == "node")
    above = top.select(F.col("number").alias("above"), F.col("conv_id").alias("above_conv"))
    below = nodes.filter(F.col("above").isNotNull()).join(above, "above").withColumn("parent_conv_id", F.col("above_conv"))
    return (nodes.filter(F.col("above").isNull()).select(RESULT)
            .unionByName(below.select(RESULT)).unionByName(top.select(RESULT)))


def prefix_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of rebuilt ``conversations (conv_id, turn, role, text)``, columns :data:`RESULT`.

    Turns are ordered by number, null ones first, equal ones by role and then digest;
    rows repeated whole are turns each.  Null roles and texts are empty.  Rows without
    an id belong to no conversation.  Ids below zero have the block of Spark's
    remainder.  Other columns, whatever their names, are not looked at; an empty table
    has no nodes, not even a root.
    """
    small_batches(conversations.sparkSession)
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return trie(written(rebuilt(whole), "trie-paths"), shards)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# CRC-32, reflected polynomial 3988292384, over the digits of an id
_STEPS = ", ".join(["0"] * 8)
OP13_SQL = f"""
WITH lines AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:{2 * KEY_BYTES}] AS key,
    strlen(coalesce(text, '')) AS size, turn, coalesce(role, '') AS role
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS pos FROM lines
), ids AS (
  SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b), {_STEPS}], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END),
    4294967295), 4294967295) % {MOST_SHARED} AS shared
  FROM (SELECT DISTINCT conv_id FROM lines)
), turned AS (
  SELECT i.conv_id, 0 AS part, p.pos, p.key, p.size FROM ids i
  JOIN placed p ON p.conv_id = i.conv_id - i.conv_id % {BLOCK} AND p.pos <= i.shared
  UNION ALL
  SELECT i.conv_id, 1, p.pos, p.key, p.size FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.pos > i.shared
), path AS (
  SELECT conv_id, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
    string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS node
  FROM turned
), member AS (
  SELECT conv_id, depth, size, node FROM path UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), last AS (SELECT conv_id, max(depth) AS depth FROM member GROUP BY conv_id),
node AS (
  SELECT m.node, min(m.conv_id) AS conv_id, any_value(m.depth) AS depth, count(*) AS n_convs, any_value(m.size) AS size,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (l.depth = m.depth), '')) AS ends_sha256
  FROM member m JOIN last l USING (conv_id) GROUP BY m.node
), child AS (
  SELECT left(node, length(node) - {2 * KEY_BYTES}) AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM node n LEFT JOIN child c USING (node)),
above AS (
  SELECT a.node, sum((k.n_convs - 1) * k.size)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM known k JOIN member a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY a.node
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, a.n_leaves, a.saved_tokens,
  k.ends_sha256
FROM known k JOIN above a USING (node)
LEFT JOIN known p ON k.depth > 0 AND p.node = left(k.node, length(k.node) - {2 * KEY_BYTES})
"""
