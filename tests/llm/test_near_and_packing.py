"""SimHash groups and packing against brute force."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import packing, simhash

NASTY = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "a b c d e f g h i j"),
    (8, "a b c d e f g h i j"), (9, "a b c d e f g h i k"), (10, "é ß 漢字   x y z"), (None, "one"),
    (20, "word " * 30_000), (21, "word " * 30_000 + "end"), (7, "a b c d e f g h i j"),
]


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(i, t, None, "x", 3, 4) for i, t in NASTY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, node int, length int")


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace(
        "\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=2):
    least = {}
    todo = set(range(len(points)))
    while todo:
        queue, group = [todo.pop()], []
        while queue:
            i = queue.pop()
            group.append(i)
            near = {j for j in todo if (points[i][1] ^ points[j][1]).bit_count() <= radius}
            todo -= near
            queue += near
        ids = [points[i][0] for i in group if points[i][0] is not None]
        for i in group:
            least[i] = min(ids) if ids else None
    return [least[i] for i in range(len(points))]


@pytest.mark.parametrize("tile_rows", [8192, 16])
def test_near_duplicates_against_brute_force(spark, sf, tile_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    points = [(i, brute_fingerprint(t)) for i, t in rows]
    want = {(i, p, c) for (i, p), c in zip(points, brute_components(points))}
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id)
           for r in simhash.near_duplicates(docs, tile_rows=tile_rows).collect()}
    assert got == want


def test_near_duplicates_of_nasty_rows(spark, nasty):
    points = [(i, brute_fingerprint(t)) for i, t in NASTY]
    want = sorted(zip([p[0] for p in points], [p[1] for p in points], brute_components(points)), key=repr)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(nasty).collect()),
                 key=repr)
    assert got == want
    assert simhash.near_duplicates(nasty.limit(0)).count() == 0


def test_similar_groups_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: set(simhash.shingles(r.text.encode(), 5)) for r in docs.collect()}
    points = sorted(i for i, s in sets.items() if s)
    root = {i: i for i in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(points, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(i, find(i)) for i in points if find(i) != i}
    got = {(r.doc_id, r.keep_id) for r in simhash.similar_groups(docs, tile_rows=64).collect()}
    assert got == want and want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len(want)


def test_similar_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + ["other"] + base[k + 1:])) for k in range(0, 200, 5)] + [(900, "x y z"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id) for r in simhash.similar_groups(docs).collect()}
    assert got == {(k, 0) for k in range(5, 200, 5)}


def test_similar_groups_beyond_the_fingerprints(spark, monkeypatch):
    """Repeated passages and short texts, which fingerprints within the radius do not propose."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(5)
    rows = []
    for k, (n, times) in enumerate([(1000, 50), (300, 10), (300, 50)]):
        words, passage = ([f"w{x}" for x in rng.integers(0, 10 ** 9, m)] for m in (n, 55))
        rows += [(10 * k, " ".join(words + passage)), (10 * k + 1, " ".join(words + passage * times))]
    for k in range(100, 140):
        words = [f"s{x}" for x in rng.integers(0, 10 ** 9, 9)]
        rows += [(10 * k, " ".join(words[:8])), (10 * k + 1, " ".join(words))]
    rows += [(5000 + k, f"a b c d e f g h {k}") for k in range(9)] + [(5100, "a b c d e f g h")]
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) == 3 + 40 + 9
    want = {(10 * k + 1, 10 * k) for k in (0, 1, 2, *range(100, 140))} | {(5000 + k, 5000) for k in (*range(1, 9), 100)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in simhash.similar_groups(docs).collect()} == want


def test_keep_first_near_copies_of_null_and_repeated_ids(spark):
    long, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, long), (5, long + " end"), (5, "single"), (None, long), (7, other), (7, other + " end"), (6, other), (9, "x")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [(3, long), (5, "single"), (None, long), (6, other), (9, "x")], key=repr)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)}


def token_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, texts):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = token_ids(text)
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [
            (k, at, min(2048, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 2048))]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert not by_doc
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = packing.packed_documents(docs).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_nasty_rows(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "<|endoftext|> x <|startoftext|>", 5: "it's I'll 've", 6: "word " * 9000,
             7: "漢字 é é   ΑΣ", 8: "a" * 5000}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()],
                                 "doc_id long, text string, ids string, length int")
    check_packing(packing.packed_documents(docs).collect(), texts)
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_packing_has_one_python_worker_a_task(spark, sf, monkeypatch):
    import public_tokenizers

    stages, written = [], packing.written

    def watched(df, label):
        stages.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return written(df, label)

    monkeypatch.setattr(packing, "written", watched)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed_documents(docs)
    assert stages == [1, 0]
    # the pieces as a table of their own have the same places
    path = public_tokenizers.path(packing.TOKENIZER)
    apart = packing.pack(packing.token_pieces(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    assert rows.exceptAll(apart.select(rows.columns)).isEmpty() and rows.count() == apart.count()


@pytest.fixture
def tokens(monkeypatch):
    """A tokenizer of words and the number of strings it learned at each call."""
    import public_tokenizers

    made, learned = packing.WordTokens(public_tokenizers.path(packing.TOKENIZER)), []
    learn = made.learn
    monkeypatch.setattr(made, "learn", lambda words, *more: (learned.append(len(words)), learn(words, *more))[1])
    return made, learned


def whole_ids(made, text):
    return made.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_are_learned_by_their_parts(tokens):
    made, learned = tokens
    words = ["house", "tree", "caf\u00e9"]
    texts = [f"{a}{sign}{b} {a.upper()}{k}{sign}" for a in words for b in words for k, sign in enumerate([".", "...", ",", "?!"])]
    assert [ids.tolist() for ids in made.packed(pa.array(texts))] == [whole_ids(made, t) for t in texts]
    # upper-case E-acute in the one word beside the lower-case one, four digits, four runs of signs
    assert learned == [3 + 1 + 4 + 4]
    made.packed(pa.array(["tree-house", "house?!9"]))
    assert learned[1:] == [2]


def test_parts_met_lately_stay_known(tokens, monkeypatch):
    made, learned = tokens
    monkeypatch.setattr(packing, "PART_CACHE", 40)
    for k in range(10):
        text = " ".join(f"stays word{chr(97 + k)}{chr(97 + x)}" for x in range(15))
        assert made.packed(pa.array([text]))[0].tolist() == whole_ids(made, text)
        assert len(made.known) == len(made.ids) == len(made.met) <= 40
    assert learned == [16] + [15] * 9
    monkeypatch.setattr(packing, "CACHE_BYTES", 100)
    made.packed(pa.array(["y" * 90 + " again"]))
    assert made.known.to_pylist() in (["again"], []) and len(made.ids) == len(made.known)


def test_ids_of_words_of_many_kinds(tokens, monkeypatch):
    made, _ = tokens
    monkeypatch.setattr(packing, "PART_CACHE", 60)
    draw = np.random.default_rng(11)
    pieces = ["a", "Bc", "the", "\u00e9", "\u00c9", "\u00d7", "\u00f7", "\u00df", "\u00b2", "1", "23", "!", "--", "_", "<|", "|>",
              "<|endoftext|>", "'", "'s", "'LL", "\u2019", " ", "\t", "\n", "\x1c", "\x85", "\u00a0", "\u6f22", "\u0301", "\u03a3",
              "\u0130", "\ufb01", "\x00", "\x7f", "\u044f", "\U0001f600"]
    for _ in range(30):
        texts = ["".join(draw.choice(pieces, n)) for n in draw.choice([0, 1, 2, 3, 9, 40], 40)] + [None]
        assert [ids.tolist() for ids in made.packed(pa.array(texts).slice(1))] == [whole_ids(made, t) for t in texts[1:]]


@pytest.mark.parametrize("histogram", [
    {}, {2048: 5}, {1: 3}, {1025: 10, 1023: 10}, {1500: 4, 600: 4, 548: 4}, {k: 1 + k % 7 for k in range(1, 2049, 3)},
])
def test_plan_uses_up_the_histogram(histogram):
    made = packing.plan(dict(histogram))
    used = {}
    for config, times in made:
        assert sum(config) <= 2048 and times > 0
        for length in config:
            used[length] = used.get(length, 0) + times
    assert used == histogram


def test_knapsack_is_exact():
    sizes, values = np.array([5, 7, 11]), np.array([5.5, 7.9, 12.0])
    best = max(a * 5.5 + b * 7.9 + c * 12.0 for a in range(7) for b in range(5) for c in range(4)
               if 5 * a + 7 * b + 11 * c <= 31)
    assert np.isclose(packing.knapsack(values, sizes, 31) @ values, best)
