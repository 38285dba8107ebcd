"""Repair of damaged conversations by the cheapest edits of their turn structure.

A conversation's rows and four states of the wanted role sequence ``(s?(ua)+)?``
span a lattice: keeping, re-roling or deleting a row goes to the next row, inserting
stays.  Dijkstra's search runs from both ends; it goes on until every crossing of
least cost has been seen and takes the least audit (the edits' initials) among them.
Two cheapest audits to one node are never prefixes of each other, since what an audit
costs follows from its letters, so least prefixes and suffixes make the least whole.

Spark does the rest on rows without texts: repeated turns are found by grouping on
digests, rows are range-partitioned by conversation and turn and sorted, and each
shard searches its conversations.  A conversation over several shards, or longer than
``SEGMENT`` rows, becomes one small table a segment (cheapest audit from each state
to each state); the tables are put together by conversation.  Texts are shuffled
once, sorted behind their conversation's audit, and hashed as they stream by: a
conversation with a third of all rows takes the memory of its audit, not of its texts.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import Batches, map_arrow, small_batches, table, written

SEGMENT = 1024
REMEMBERED_ROWS = 64

# --- fixed values: edits with their costs, faults, legal neighbours
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
LEGAL = frozenset(["su", "ua", "au"])
SPACE = " \t\n\x0b\f\r"
#: Damages by checksum: a row is dropped, emptied, loses its ends, is repeated, or becomes a user's.
DROP, EMPTY, UNEND, REPEAT, AS_USER = range(5)
DAMAGES = 20

# --- states of the role sequence and what a role leads to
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or re-roled row
BEFORE_FREE = {to: tuple(s for s in STATES if FREE[s] == to) for to in STATES}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cheapest insertions behind the last row.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Node = tuple[int, int]
Audit = tuple[int, str]


def _forward(i: int, state: int, initials: str, faults: str, tail: bool) -> Iterator[tuple[int, str, Node]]:
    n = len(initials)
    if i < n:
        yield DELETE_COST, DELETE, (i + 1, state)
        if faults[i] not in "bd":
            extra = TRUNCATED_COST if faults[i] == "t" else 0
            kept = NEXT.get((state, initials[i]))
            if kept is not None:
                yield extra, KEEP, (i + 1, kept)
            yield REROLE_COST + extra, REROLE, (i + 1, FREE[state])
    if i < n or tail:
        yield INSERT_COST, INSERT, (i, FREE[state])


def _backward(i: int, state: int, initials: str, faults: str, tail: bool) -> Iterator[tuple[int, str, Node]]:
    if i > 0:
        yield DELETE_COST, DELETE, (i - 1, state)
        if faults[i - 1] not in "bd":
            extra = TRUNCATED_COST if faults[i - 1] == "t" else 0
            for before in STATES:
                if NEXT.get((before, initials[i - 1])) == state:
                    yield extra, KEEP, (i - 1, before)
            for before in BEFORE_FREE[state]:
                yield REROLE_COST + extra, REROLE, (i - 1, before)
    if i < len(initials) or tail:
        for before in BEFORE_FREE[state]:
            yield INSERT_COST, INSERT, (i, before)


def cheapest(initials: str, faults: str, start: int, goals: tuple[int, ...], tail: bool) -> Audit | None:
    """Least (cost, audit) from ``start`` before the first row to one of ``goals`` behind the last.

    ``initials`` has one of ``suax`` for each row, ``faults`` ``b`` (blank), ``d``
    (duplicate), ``t`` (truncated) or ``-``; ``tail`` allows insertions at the end.
    Both heaps grow in turn, the cheaper first, until the sum of their least costs
    passes the best crossing.
    """
    n = len(initials)
    ahead: list[tuple[int, str, Node]] = [(0, "", (0, start))]
    behind: list[tuple[int, int, int]] = [(0, -n, g) for g in goals]
    to: dict[Node, Audit] = {}                                    # settled from the start
    rest: dict[Node, Audit] = {}                                  # settled from the end
    found: dict[Node, Audit] = {(n, g): (0, "") for g in goals}   # seen from the end
    best: Audit | None = None
    while ahead and behind:
        low, high = ahead[0][0], behind[0][0]
        if best is not None and low + high > best[0]:
            break
        if low <= high:
            cost, audit, node = heapq.heappop(ahead)
            if node in to:
                continue
            to[node] = cost, audit
            if node in rest:
                met = cost + rest[node][0], audit + rest[node][1]
                best = met if best is None or met < best else best
            for price, letter, other in _forward(*node, initials, faults, tail):
                if other in rest:
                    met = cost + price + rest[other][0], audit + letter + rest[other][1]
                    best = met if best is None or met < best else best
                if other not in to:
                    heapq.heappush(ahead, (cost + price, audit + letter, other))
        else:
            # of equal costs later rows come first: keeping costs nothing and leads to an earlier row
            cost, at, state = heapq.heappop(behind)
            node = (-at, state)
            if node in rest:
                continue
            rest[node] = cost, audit = found.pop(node)
            if node in to:
                met = to[node][0] + cost, to[node][1] + audit
                best = met if best is None or met < best else best
            for price, letter, other in _backward(*node, initials, faults, tail):
                label = cost + price, letter + audit
                if other in to:
                    met = to[other][0] + label[0], to[other][1] + label[1]
                    best = met if best is None or met < best else best
                if other not in rest and (other not in found or label < found[other]):
                    found[other] = label
                    heapq.heappush(behind, (label[0], -other[0], other[1]))
    return best


@lru_cache(maxsize=100_000)
def _remembered(initials: str, faults: str) -> Audit:
    return cheapest(initials, faults, START, (START, ASSISTANT), True)


def segments(initials: str, faults: str) -> Iterator[list[Audit | None]]:
    """Tables of the segments of a piece: entry ``4 * s + t`` leads from state ``s`` to ``t``, ending with a row."""
    for at in range(0, len(initials), SEGMENT):
        part = initials[at:at + SEGMENT], faults[at:at + SEGMENT]
        yield [cheapest(*part, s, (t,), False) for s in STATES for t in STATES]


def put_together(tables: Iterable[list[Audit | None]]) -> Audit:
    """Least (cost, audit) of a whole conversation from the tables of its segments in order.

    Costs to the end are found from the back.  From the front, the states that share
    the least audit so far choose the least of the parts on a cheapest way: parts of
    one segment end with the same row, so none is a prefix of another.
    """
    costs, parts = [], []
    for entries in tables:
        costs.append([e[0] if e else None for e in entries])
        parts.append(zlib.compress("\n".join(e[1] if e else "" for e in entries).encode()))
    after = {t: INSERT_COST * len(TAIL[t]) for t in STATES}
    left = [after]
    for row in reversed(costs):
        after = {s: min((row[4 * s + t] + after[t] for t in STATES if row[4 * s + t] is not None and t in after), default=None)
                 for s in STATES}
        after = {s: c for s, c in after.items() if c is not None}
        left.append(after)
    left.reverse()
    total, states, out = left[0][START], {START}, []
    for k, row in enumerate(costs):
        audits = zlib.decompress(parts[k]).decode().split("\n")
        ways = [(audits[4 * s + t], t) for s in states for t in STATES
                if row[4 * s + t] is not None and t in left[k + 1] and row[4 * s + t] + left[k + 1][t] == left[k][s]]
        least = min(a for a, _ in ways)
        states = {t for a, t in ways if a == least}
        out.append(least)
    return total, "".join(out) + min(TAIL[t] for t in states)


def audit_of(initials: str, faults: str) -> Audit:
    if len(initials) <= REMEMBERED_ROWS:
        return _remembered(initials, faults)
    if len(initials) <= SEGMENT:
        return cheapest(initials, faults, START, (START, ASSISTANT), True)
    return put_together(segments(initials, faults))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``conv_id, turn, role, text``, null roles and texts one space."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % DAMAGES
    text = F.coalesce("text", F.lit(" "))
    return (conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter(F.col("kind") != DROP)
            .select("conv_id", "turn",
                    F.when(F.col("kind") == AS_USER, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                    F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNEND, F.translate(text, ".!?", ""))
                    .otherwise(text).alias("text"),
                    F.explode(F.when(F.col("kind") == REPEAT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


#: Order of a conversation's rows; ``known`` is false for null turns.
ORDER = ["known", "turn", "role", "key"]


def _placed(rows: DataFrame) -> list[Column]:
    text = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return [F.col("conv_id"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"),
            F.col("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")]


def outlines(rows: DataFrame) -> DataFrame:
    """Rows without texts: place, digest, initial and fault (repeated turns not yet)."""
    shown = F.expr("trim(TRAILING ' \\t\\n\\u000B\\f\\r' FROM text)")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    fault = F.when(shown == "", "b").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")
    return rows.select(*_placed(rows), initial.alias("initial"), fault.alias("fault"))


PIECE = ("whole boolean, shard int, seq int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
         "first string, last string, costs array<long>, audits array<string>")


def _illegal(initials: str) -> int:
    return sum(initials[k:k + 2] not in LEGAL for k in range(len(initials) - 1))


def _piece(conv, initials: str, faults: str, shard: int, whole: bool) -> Iterator[dict]:
    counts = {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
              "illegal": _illegal(initials), "first": initials[0], "last": initials[-1]}
    row = {"conv_id": conv, "whole": whole, "shard": shard, "seq": 0, **counts,
           "cost": None, "audit": None, "costs": None, "audits": None}
    if whole:
        row["cost"], row["audit"] = audit_of(initials, faults)
        yield row
        return
    for seq, entries in enumerate(segments(initials, faults)):
        yield {**row, "seq": seq, "costs": [e and e[0] for e in entries], "audits": [e and e[1] for e in entries]}
        row.update(blank=0, duplicate=0, truncated=0, illegal=0)


def _columns(rows: list[dict]) -> dict:
    return {name: [r[name] for r in rows] for name in rows[0]}


def _search(batches: Batches) -> Iterator[dict]:
    """Sorted rows of a shard to one row a conversation, or tables for its first and last, which may go on outside."""
    shard, held, out = TaskContext.get().partitionId(), None, []
    conv, first, last_key = object(), True, None
    initials: list[str] = []
    faults: list[str] = []
    for batch in batches:
        for place in zip(*(c.to_pylist() for c in batch.select(["conv_id", *ORDER, "initial", "fault", "repeats"]).columns)):
            if place[0] != conv:
                if initials:
                    out.extend(_piece(conv, "".join(initials), "".join(faults), shard, not first))
                    first = False
                conv, initials, faults, last_key = place[0], [], [], None
            key, (initial, fault, repeats) = place[1:5], place[5:]
            initials.append(initial)
            faults.append("d" if fault != "b" and (repeats or key == last_key) else fault)
            last_key = key
        if len(out) >= 1000:
            yield _columns(out)
            out = []
    if initials:
        out.extend(_piece(conv, "".join(initials), "".join(faults), shard, False))
    if out:
        yield _columns(out)


def _fold(batches: Batches) -> Iterator[dict]:
    """Pieces sorted by conversation, shard and sequence to one row a conversation."""
    names = ["conv_id", "seq", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "audits"]
    conv, sums, last, tables = object(), None, None, []

    def done():
        cost, audit = put_together((_decoded(*t) for t in tables))
        return {"conv_id": [conv], **{k: [v] for k, v in sums.items()}, "cost": [cost], "audit": [audit]}

    for batch in batches:
        for row in batch.select(names).to_pylist():
            if sums is None or row["conv_id"] != conv:
                if sums is not None:
                    yield done()
                conv, last, tables = row["conv_id"], None, []
                sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            for name in sums:
                sums[name] += row[name]
            if row["seq"] == 0:  # pieces of two shards meet
                sums["illegal"] += last is not None and last + row["first"] not in LEGAL
            last = row["last"]
            tables.append((row["costs"], zlib.compress("\n".join(a or "" for a in row["audits"]).encode())))
    if sums is not None:
        yield done()


def _decoded(costs: list[int | None], audits: bytes) -> list[Audit | None]:
    return [None if c is None else (c, a) for c, a in zip(costs, zlib.decompress(audits).decode().split("\n"))]


RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(lines: DataFrame, ids: str) -> DataFrame:
    """``conv_id``, fault counts, cost and audit of every conversation that has rows in ``lines``."""
    at = lambda known, turn: F.struct(F.col(known), F.col(turn))
    twice = (lines.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.min(at("known", "turn")).alias("first_at"))
             .filter(F.col("n") > 1).withColumnsRenamed({"conv_id": "twice_conv", "key": "twice_key"}).drop("n"))
    marked = lines.join(twice, F.col("conv_id").eqNullSafe(F.col("twice_conv")) & (F.col("key") == F.col("twice_key")), "left")
    placed = marked.select("conv_id", *ORDER, "initial", "fault",
                           F.coalesce(at("known", "turn") > F.col("first_at"), F.lit(False)).alias("repeats"))
    shards = placed.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    pieces = written(map_arrow(shards, _search, f"conv_id {ids}, {PIECE}"), "conversation-pieces")
    over = (pieces.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "shard", "seq"))
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return pieces.filter("whole").select(names).unionByName(map_arrow(over, _fold, f"conv_id {ids}, {RESULT}"))


def repaired_rows(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, row by row."""
    state, letters = START, iter(audit)
    for role, text in rows:
        letter = next(letters)
        while letter == INSERT:
            state = FREE[state]
            yield ROLE[state], ""
            letter = next(letters)
        if letter == DELETE:
            continue
        state = NEXT[state, role[0]] if letter == KEEP else FREE[state]
        yield (role if letter == KEEP else ROLE[state]), text
    for _ in letters:
        state = FREE[state]
        yield ROLE[state], ""


class _Hash:
    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "replace"))
        self.any = True


def _hash_texts(batches: Batches) -> Iterator[dict]:
    """Rows sorted behind their conversation's audit: one row a conversation with the digest of its repaired text."""
    head: dict | None = None
    digest = letters = None
    state = START
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def inserted() -> str | None:
        nonlocal state
        for letter in letters:
            if letter != INSERT:
                return letter
            state = FREE[state]
            digest.add(ROLE[state], "")
        return None

    def done() -> dict:
        inserted()
        return {**{k: [head[k]] for k in names}, "repaired_sha256": [digest.sha.hexdigest()]}

    for batch in batches:
        wanted = batch.select(["body", "role", "text"]).columns
        for k, (body, role, text) in enumerate(zip(*(c.to_pylist() for c in wanted))):
            if not body:
                if head is not None:
                    yield done()
                head = batch.select(names).slice(k, 1).to_pylist()[0]
                digest, letters, state = _Hash(), iter(head["audit"]), START
                continue
            letter = inserted()
            if letter == DELETE:
                continue
            state = NEXT[state, role[0]] if letter == KEEP else FREE[state]
            digest.add(role if letter == KEEP else ROLE[state], text)
    if head is not None:
        yield done()


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations (conv_id, turn, role, text)``: what is wrong and how it is mended.

    ``rows`` are the rows to mend, those of ``conversations`` after :func:`damaged`
    unless given.  Columns: ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.  Rows are taken by turn, null
    turns first, of equal turns by role and then by digest of the text; rows that are
    repeated whole are duplicates of the first.  Null roles and texts are one space,
    a null id is a conversation of its own.  Conversations without rows left have
    zeros and the digest of an empty text.  Roles that begin with none of ``s``, ``u``
    and ``a``, and empty ones, cannot be kept.  Other columns are not looked at; an
    empty table gives an empty result.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    ids = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations) if rows is None else rows
    lines = written(outlines(rows), "conversation-outlines")
    gaps = lines.filter("known").groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    found = audits(lines, ids)
    everyone = conversations.select("conv_id").distinct()
    mended = _beside(_beside(everyone, gaps), found)
    zeros = {n: F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    heads = mended.select("conv_id", F.lit(False).alias("body"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("turn"),
                          F.lit("").alias("role"), F.lit(b"").alias("key"), F.lit("").alias("text"),
                          *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"))
    bodies = rows.select(*_placed(rows), "text", F.lit(True).alias("body")).withColumn("turn", F.col("turn").cast("long"))
    both = heads.unionByName(bodies, allowMissingColumns=True)
    streams = both.repartition("conv_id").sortWithinPartitions("conv_id", "body", *ORDER)
    return map_arrow(streams, _hash_texts, f"conv_id {ids}, gaps long, {RESULT}, repaired_sha256 string")


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by ``conv_id``, null ids equal."""
    named = right.withColumnRenamed("conv_id", "right_conv")
    return left.join(named, F.col("conv_id").eqNullSafe(F.col("right_conv")), "left").drop("right_conv")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
