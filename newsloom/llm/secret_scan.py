"""Secrets in texts: patterns of credentials, and assignments read as source or configuration.

Three base patterns are matched everywhere.  Beside them, the text is lexed into
statements ``name = literal``, ``name: literal``, ``"name": literal`` and
``name = other``; names that are bound to other names are followed to their
literals, and a literal is a secret if a name that reaches it is sensitive
enough for how random the literal looks.  Such a literal is a span of kind
``named`` unless one base span covers the whole of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import map_arrow, small_batches, table

# --- fixed values: the base patterns, least lengths, and the order of kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "named")

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# --- assignments
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
# values: long and short strings with escapes, a name, or a bare word that is no call, subscript, tag or reference
VALUE = (
    r'''"""(?P<long>(?s:.*?))"""|\'{3}(?P<long1>(?s:.*?))\'{3}'''
    r'''|"(?P<double>(?:[^"\\\n]|\\[^\n])*)"|\'(?P<single>(?:[^'\\\n]|\\[^\n])*)\''''
    rf'''|(?P<other>{NAME})(?![A-Za-z0-9_.\-/+=(\[])'''
    rf'''|(?!{NAME}[(\[]|[!&*<|>]|\$[{{(A-Za-z_])(?P<bare>[^\s"',;)\]}}]+)''')
STATEMENT = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])["']?(?P<name>{NAME})["']?[\x20\t]*(?::=|=>|=(?!=)|:)[\x20\t]*(?:{VALUE})""")
GROUPS = ("long", "long1", "double", "single", "other", "bare")

#: How sensitive parts of a name are; a name scores its most sensitive part.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "apikey": 0.9, "accesskey": 0.9, "authtoken": 0.9, "token": 0.8, "auth": 0.6, "key": 0.5,
    "signature": 0.5, "salt": 0.5, "cert": 0.4, "dsn": 0.5, "connection": 0.4,
}
LEAST_SCORE = 1.0
LEAST_LITERAL = 6


def name_score(name: str) -> float:
    """Sensitivity of a name by its parts (``dbPassword``, ``API-KEY``) and pairs of parts."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


def literal_score(text: str) -> float:
    """From 0 to 1: how much a literal looks drawn at random (bits for each character, mixed classes)."""
    if any(c.isspace() for c in text):
        # prose, unless a word of it has letters of both cases and digits
        mixed = [w for w in text.split() if all(any(f(c) for c in w) for f in (str.islower, str.isupper, str.isdigit))]
        return max(map(literal_score, mixed), default=0.0)
    if len(text) < LEAST_LITERAL:
        return 0.0
    counts = Counter(text)
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    kinds = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 4.0 * 0.7 + 0.15 * (kinds - 1))


def named_literals(text: str) -> list[tuple[int, int, float]]:
    """``start, end, score`` of the literals that sensitive names reach."""
    literals: dict[str, list[tuple[int, int, str]]] = {}
    aliases: list[tuple[str, str]] = []
    names: set[tuple[int, int]] = set()
    for m in STATEMENT.finditer(text):
        name = m["name"]
        group = next(g for g in GROUPS if m[g] is not None)
        if group == "other":
            aliases.append((name, m["other"]))
            names.add(m.span("other"))
        literals.setdefault(name, []).append((*m.span(group), m[group]))
    score = {name: name_score(name) for name in literals}
    known = set(literals)
    # a sensitive name makes the constants it is bound to sensitive, however many hops away;
    # the most sensitive name is taken first, so a score rises once
    bound_to: dict[str, list[str]] = {}
    for name, other in aliases:
        if other in known:
            bound_to.setdefault(name, []).append(other)
    waiting = sorted(score, key=score.__getitem__)
    while waiting:
        name = waiting.pop()
        for other in bound_to.get(name, ()):
            if score[name] > score[other]:
                score[other] = score[name]
                waiting.append(other)
    found = {}
    bound = {(name, other) for name, other in aliases if other in known}
    for name, places in literals.items():
        if score[name] <= 0:
            continue
        for start, end, value in places:
            if (name, value) in bound or (start, end) in names and not any(c.isdigit() for c in value):
                continue  # a constant or a name bound elsewhere, not a literal
            total = score[name] + literal_score(value)
            if literal_score(value) > 0 and total >= LEAST_SCORE:
                found[start, end] = max(total, found.get((start, end), 0.0))
    return [(start, end, s) for (start, end), s in sorted(found.items())]


_TO_HEX = {c: "0" if c in "0123456789abcdef" else " " for c in map(chr, range(256))}
_HEX_TABLE = bytes.maketrans(bytes(range(256)), "".join(_TO_HEX.values()).encode())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns in code points, by start, then kind."""
    spans = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a cheap look for any long run before the pattern is tried everywhere
    if b"0" * 32 in text.encode("latin-1", "replace").translate(_HEX_TABLE):
        spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def secrets(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    if "=" in text or ":" in text:
        more = [(start, end, "named") for start, end, _ in named_literals(text)
                if not any(a <= start and end <= b for a, b, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans, secrets`` of every row: spans as text and the texts they cover.

    Null texts are empty and have no spans; offsets are code points, ends
    exclusive.  Rows that repeat an id are scanned each.  Columns other than
    ``doc_id`` and ``text`` are not looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [secrets(t) for t in texts]
            yield {"doc_id": batch.column("doc_id"), "base": [_joined(b) for b, _ in found],
                   "spans": [_joined(a) for _, a in found],
                   "secrets": [[t[s:e] for s, e, _ in a] for t, (_, a) in zip(texts, found)]}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(source, run, "doc_id long, base string, spans string, secrets array<string>")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    kinds = F.split("base", ",")
    count = lambda kind: F.size(F.filter(kinds, lambda s: s.startswith(f"{kind}:"))).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                        "spans")
