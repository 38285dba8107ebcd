"""The trie of rebuilt conversations against nodes made one by one."""

import collections
import hashlib
import random
import zlib

import pytest

from newsloom.llm import conversation_trie as ct


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, role, key, len(text.encode())))
    for lines in own.values():
        lines.sort()
    paths = {}
    for conv, lines in own.items():
        shared = zlib.crc32(str(conv).encode()) % 9
        paths[conv] = [x[3:] for x in own.get(conv - conv % 5, [])[:shared] + lines[shared:]]
    members = collections.defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(k for k, _ in path[:d])].append(conv)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, of in members.items():
        size = paths[of[0]][len(node) - 1][1] if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * size
    return sorted((
        min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node)).encode()).hexdigest(),
    ) for node, of in members.items()) if paths else []


def nodes(frame):
    return sorted((tuple(r) for r in frame.select(ct.RESULT).collect()), key=lambda r: (r[0], r[1]))


KIND = "conv_id long, turn long, role string, text string"


def drawn(rng, convs):
    """Conversations with many common beginnings, and a third that are all alike."""
    rows = []
    for conv in convs:
        words = ["same"] * 6 if rng.random() < 0.3 else [rng.choice("ab") + "é" * rng.randrange(2) for _ in range(rng.randrange(1, 9))]
        rows += [(conv, k, "user" if k % 2 else "assistant", w) for k, w in enumerate(words)]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 11])
def test_nodes_over_shards(spark, shards):
    rows = drawn(random.Random(shards), [*range(150), *range(1001, 1150, 3)])
    got = nodes(ct.prefix_trie(spark.createDataFrame(rows, KIND).repartition(4), shards))
    assert got == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_splitters_shorter_than_their_paths(spark):
    rows = [(c, k, "user", f"{k if k < 90 else c * k}") for c in range(5, 400, 5) for k in range(95)]
    got = nodes(ct.prefix_trie(spark.createDataFrame(rows, KIND), 4))
    assert got == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_query_finds_every_node(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(ct.op13_conversation_trie(spark, sf)) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_odd_rows(spark):
    rows = [(3, None, None, None), (3, None, "user", ""), (3, 1, "user", "é"), (3, 1, "user", "é"), (None, 0, "user", "x"),
            (8, 5, "user", "z" * 200_000), (11, 0, "user", "only"), (-4, -1, "a", "n"), (-4, 2, "", None), (15, 0, "u", "h"), (16, 3, "u", "h")]
    rows += [(c, 0, "user", "short") for c in range(21, 25)]  # some are left without a turn
    rows += [(c, k, "user", f"{c} {k}" + "z" * 100_000 * (c == 5)) for c in (0, 5, 10) for k in (None, 1, 2)]
    frame = spark.createDataFrame(rows, KIND)
    clash = frame.selectExpr("*", "'k' AS path", "1 AS shard", "2 AS sizes", "'l' AS line", "3 AS number")
    wanted = brute([r for r in rows if r[0] is None or r[0] >= 0])
    assert nodes(ct.prefix_trie(clash.filter("conv_id IS NULL OR conv_id >= 0"))) == wanted and len(wanted) > 10
    assert any(r[1] == 0 and r[7] != ct.NO_ENDS for r in wanted)
    root = nodes(ct.prefix_trie(clash))[0]
    assert root[:2] == (-4, 0) and root[3] == len({r[0] for r in rows} - {None})
    assert ct.prefix_trie(frame.limit(0)).collect() == []
