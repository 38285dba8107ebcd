"""Repair of conversations: the search against full enumeration, the query against a plain replay."""

import hashlib
import random
import zlib

import pytest

from newsloom.llm import conversation_repair as cr

WHITE = " \t\n\x0b\f\r"


def enumerated(initials, faults):
    """Least (cost, audit) by trying every sequence of edits."""
    best = None

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(initials) and state in (cr.START, cr.ASSISTANT):
            best = (cost, audit) if best is None else min(best, (cost, audit))
        if inserted < 3:
            go(i, cr.FREE[state], cost + 3, audit + "I", inserted + 1)
        if i < len(initials):
            go(i + 1, state, cost + 4, audit + "D", 0)
            if faults[i] not in "bd":
                extra = 3 if faults[i] == "t" else 0
                if (state, initials[i]) in cr.NEXT:
                    go(i + 1, cr.NEXT[state, initials[i]], cost + extra, audit + "K", 0)
                go(i + 1, cr.FREE[state], cost + 3 + extra, audit + "R", 0)

    go(0, cr.START, 0, "", 0)
    return best


def by_rows(initials, faults):
    """The same row by row with the least label of each state."""
    def settled(labels):
        for _ in range(4):
            for state, (cost, audit) in list(labels.items()):
                label = cost + 3, audit + "I"
                labels[cr.FREE[state]] = min(labels.get(cr.FREE[state], label), label)
        return labels

    labels = settled({cr.START: (0, "")})
    for initial, fault in zip(initials, faults):
        ahead = {}
        for state, (cost, audit) in labels.items():
            ways = [(state, 4, "D")]
            if fault not in "bd":
                extra = 3 if fault == "t" else 0
                ways.append((cr.FREE[state], 3 + extra, "R"))
                if (state, initial) in cr.NEXT:
                    ways.append((cr.NEXT[state, initial], extra, "K"))
            for to, price, letter in ways:
                label = cost + price, audit + letter
                ahead[to] = min(ahead.get(to, label), label)
        labels = settled(ahead)
    return min(labels[s] for s in (cr.START, cr.ASSISTANT) if s in labels)


def drawn(rng, n):
    return "".join(rng.choice("suuaax") for _ in range(n)), "".join(rng.choice("---tbd") for _ in range(n))


def test_search_finds_the_least_audit_of_all():
    rng = random.Random(1)
    for _ in range(400):
        case = drawn(rng, rng.randrange(6))
        assert cr.audit_of(*case) == enumerated(*case) == by_rows(*case), case


def test_segments_make_the_same_whole(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        monkeypatch.setattr(cr, "SEGMENT", rng.choice([1, 2, 3, 7]))
        case = drawn(rng, rng.randrange(1, 50))
        assert cr.put_together(cr.segments(*case)) == by_rows(*case), case
        assert cr.cheapest(*case, cr.START, (cr.START, cr.ASSISTANT), True) == by_rows(*case), case


def replayed(rows):
    """The contract's result for original rows, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        turns = {t for t, _, _ in kept if t is not None}
        faults, seen = [], set()
        for _, role, text in kept:
            shown = text.rstrip(WHITE)
            faults.append("b" if not shown.strip(WHITE) else "d" if (role, text) in seen else "-" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        heads = [role[:1] if role[:1] in set("sua") else "x" for _, role, _ in kept]
        cost, audit = by_rows("".join(heads), faults)
        fixed = list(cr.repaired_rows(audit, [(r, t) for _, r, t in kept]))
        roles = "".join(r[0] for r, _ in fixed)
        assert roles in ("", "s" * (roles[:1] == "s") + "ua" * (len(roles) // 2)) and roles != "s"
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def results(frame):
    rows = frame.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_repairs_every_conversation(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert results(cr.op12_conversation_repair(spark, sf)) == replayed(rows)


ODD = [
    (1, None, None, None), (1, None, "user", "a."), (1, 3, "user", "a."), (1, 3, "assistant", " b \t"), (1, 9, "tool", "c!"),
    (None, 0, "user", "q?"), (None, 1, "assistant", "r."), (2, 5, "user", ""), (3, 7, "", "x."), (4, 0, "system", "s."),
    (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 1, "user", "same."), (6, 0, "user", "z" * 300_000 + "."),
    (6, 1, "assistant", "é\n漢。"), (-7, -3, "user", "n."), (-7, -1, "assistant", "m."),
]


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    clash = frame.selectExpr("*", "1 AS key", "true AS known", "'k' AS kind", "0 AS audit", "2 AS right_conv")
    assert results(cr.repair(clash)) == replayed(ODD)
    assert cr.repair(frame.limit(0)).collect() == []


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_a_conversation_over_many_shards(spark, coalesce):
    rng = random.Random(5)
    rows = [(8, k, rng.choice(["user", "assistant", "assistant", "system"]), f"text {rng.randrange(900)}" + rng.choice([".", "!", ""]))
            for k in range(1500)]
    rows += [(c, k, ("user", "assistant")[k % 2], f"t{c} {k}.") for c in (7, 9, 10) for k in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, coalesce)
    try:
        assert results(cr.repair(frame)) == replayed(rows)
    finally:
        spark.conf.set(key, before)
