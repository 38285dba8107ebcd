"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

import re

from newsloom import constants as C
from newsloom.functions.providers import embed_text
from newsloom.operators.lexical import query_terms
from newsloom.sources import fixtures as X


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def squeeze(col: str) -> str:
    return rf"trim(regexp_replace({col}, '\s+', ' ', 'g'))"


def sentences(col: str) -> str:
    marked = rf"regexp_replace({squeeze(col)}, '([.!?。！？])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: trim(s) <> '')"


def lead(col: str, count: int) -> str:
    return f"array_to_string({sentences(col)}[1:{count}], ' ')"


STOP = "[" + ", ".join(text(w) for w in C.STOP_WORDS) + "]"


def tokens(col: str) -> str:
    words = rf"regexp_extract_all(lower(coalesce({col}, '')), '[\p{{L}}\p{{N}}]+')"
    return f"list_filter({words}, lambda w: NOT list_contains({STOP}, w))"


# --- URLs -----------------------------------------------------------------------------

def url_part(col: str, group: int) -> str:
    return rf"regexp_extract({col}, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)', {group})"


def url_path(col: str) -> str:
    return f"regexp_replace({url_part(col, 3)}, ';[^/]*$', '')"


def normalize_url(col: str) -> str:
    scheme = f"lower({url_part(col, 1)})"
    return (
        f"(CASE WHEN {scheme} = '' THEN '' ELSE {scheme} || ':' END || {url_part(col, 2)}"
        f" || regexp_replace({url_path(col)}, '/+$', ''))"
    )


def slug(col: str) -> str:
    last = rf"regexp_extract(regexp_replace({url_path(col)}, '/+$', ''), '[^/]*$')"
    return rf"substring(regexp_replace({last}, '[^\w\-]', '', 'g'), 1, {C.MAX_SLUG_CHARS})"


def category(col: str) -> str:
    rules = " ".join(f"WHEN contains(lower({col}), '{f}') THEN '{c}'" for f, c in C.CATEGORY_RULES)
    return f"CASE {rules} ELSE '{C.DEFAULT_CATEGORY}' END"


def is_article_url(col: str, domains: list[str]) -> str:
    host = f"substring({url_part(col, 2)}, 3)"
    on_site = " OR ".join([f"{host} = ''", *[f"ends_with({host}, '{d}')" for d in domains]])
    banned = " OR ".join(f"contains(lower({col}), '{f}')" for f in C.NON_ARTICLE_FRAGMENTS)
    parts = f"len(list_filter(string_split({url_path(col)}, '/'), lambda p: p <> ''))"
    return f"(({on_site}) AND NOT ({banned}) AND {parts} >= 2)"


# --- HTML -----------------------------------------------------------------------------

def without_noise(col: str) -> str:
    return rf"regexp_replace({col}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"


def inner_text(col: str) -> str:
    from newsloom.functions.html import ENTITIES

    out = rf"regexp_replace(regexp_replace({col}, '(?i)<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        out = f"replace({out}, {text(entity)}, {text(char)})"
    return strip(out)


def element(col: str, tag: str) -> str:
    return rf"regexp_extract({col}, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)"


def paragraphs(col: str) -> str:
    body = rf"regexp_extract({col}, '(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)', 1)"
    pieces = rf"string_split_regex({body}, '(?is)<p(?:\s[^>]*)?>')"
    cut = r"regexp_replace(x, '(?is)</p\s*>.*$', '')"
    return f"list_transform(({pieces})[2:], lambda x: {inner_text(cut)})"


def kept_paragraphs(col: str) -> str:
    return (
        f"list_filter({paragraphs(col)}, lambda t: length(t) > 30 AND NOT contains(t, 'Advertisement')"
        " AND NOT contains(t, 'copyright') AND NOT contains(t, 'Subscriber Agreement')"
        " AND NOT starts_with(t, 'Write to '))"
    )


# --- documents as articles and chunks ------------------------------------------------------

PUBLISHED = f"TIMESTAMP '{X.FIRST_MOMENT}' + to_minutes(((doc_id * 7919) % {X.MINUTES})::INT)"

FILES = f"""
files AS (
  SELECT d.doc_id, 'articles/' || source || '/' || d.doc_id || '.json' AS path,
         substring({sentences('d.text')}[1], 1, {X.TITLE_CHARS}) AS title,
         'https://example.com/' || source || '/' || d.doc_id AS url,
         d.text AS content, lang AS author, source AS category, source,
         {PUBLISHED.replace('doc_id', 'd.doc_id')} AS published_at,
         coalesce(l.quality = 1, false) AS is_exclusive
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

ERROR = f"""CASE WHEN coalesce({strip('title')}, '') = '' THEN 'Missing title'
  WHEN {strip('content')} = '' THEN 'Missing content'
  WHEN length({strip('content')}) < {C.MIN_CONTENT_CHARS}
    THEN 'Content too short (' || length({strip('content')}) || ' chars)'
  WHEN {strip('url')} = '' THEN 'Missing URL' END"""

ARTICLES = FILES + f""",
articles AS (
  SELECT doc_id, path, md5({normalize_url('url')}) AS article_id, {strip('title')} AS title, url,
         {strip('content')} AS content, source, category, {squeeze('author')} AS author,
         is_exclusive, published_at
  FROM files WHERE ({ERROR}) IS NULL
)"""

_SIZE = C.CHUNK_TOKENS * C.CHARS_PER_TOKEN
_OVERLAP = C.OVERLAP_TOKENS * C.CHARS_PER_TOKEN


def windows(col: str, size: int, overlap: int) -> str:
    return f"list_transform(range(0, length({col}), {size - overlap}), lambda i: substring({col}, (i + 1)::BIGINT, {size}))"


def packed(sents: str, size: int = _SIZE, overlap: int = _OVERLAP) -> str:
    """List of chunks of a sentence list, as a fold over the sentences."""
    none = "[]::VARCHAR[]"
    item = f"{{'done': {none}, 'cur': {none}, 'used': 0::BIGINT, 's': x}}"
    start = f"{{'done': {none}, 'cur': {none}, 'used': 0::BIGINT, 's': ''}}"
    tail = (
        "list_filter(a.cur, lambda y, i: list_sum(list_transform(a.cur[i:], lambda z: length(z) + 1)) - 1"
        f" <= {overlap})"
    )
    flushed = f"list_concat(a.done, CASE WHEN len(a.cur) > 0 THEN [array_to_string(a.cur, ' ')] ELSE {none} END)"
    step = f"""CASE
      WHEN length(e.s) > {size} THEN {{'done': list_concat({flushed}, {windows('e.s', size, overlap)}),
        'cur': {none}, 'used': 0::BIGINT, 's': ''}}
      WHEN a.used + length(e.s) > {size} AND len(a.cur) > 0 THEN {{'done': {flushed},
        'cur': list_append({tail}, e.s),
        'used': (coalesce(list_sum(list_transform({tail}, lambda z: length(z) + 1)), 0) + length(e.s) + 1)::BIGINT, 's': ''}}
      ELSE {{'done': a.done, 'cur': list_append(a.cur, e.s), 'used': (a.used + length(e.s) + 1)::BIGINT, 's': ''}}
    END"""
    fold = f"list_reduce(list_transform({sents}, lambda x: {item}), lambda a, e: {step}, {start})"
    return fold


CHUNKS = ARTICLES + f""",
folded AS (SELECT *, {packed(sentences('content'))} AS f FROM articles),
chunk_lists AS (
  SELECT * EXCLUDE (f), list_concat(f.done, CASE WHEN len(f.cur) > 0 THEN [array_to_string(f.cur, ' ')] ELSE []::VARCHAR[] END) AS parts,
         {lead("content", 5)} AS article_summary
  FROM folded
),
chunks AS (
  SELECT article_id, article_id || '_' || (i - 1) AS chunk_id, (i - 1)::INT AS chunk_index, title, url, source,
         category, author, is_exclusive, published_at, parts[i] AS content, article_summary,
         {lead('parts[i]', 2)} AS chunk_summary
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM chunk_lists)
)"""


def vectors(rows: str = "chunks", col: str = "content", dim: int = 64, name: str = "vectors") -> str:
    """CTE ``name(chunk_id, content_vector)`` of the word-bucket histogram."""
    plain = f""",
word_rows AS (SELECT chunk_id, unnest({tokens(col)}) AS w FROM {rows}),
bucket_rows AS (
  SELECT chunk_id, (('0x' || substr(md5(w), 1, 4))::INT) % {dim} AS b, count(*) AS n FROM word_rows GROUP BY ALL
),
norms AS (SELECT chunk_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM bucket_rows GROUP BY ALL),
vectors AS (
  SELECT c.chunk_id, list(CASE WHEN m.norm > 0 THEN (coalesce(b.n, 0) / m.norm)::FLOAT ELSE 0::FLOAT END ORDER BY g.b) AS content_vector
  FROM {rows} c CROSS JOIN (SELECT unnest(range({dim})) AS b) g
  LEFT JOIN bucket_rows b ON b.chunk_id = c.chunk_id AND b.b = g.b
  LEFT JOIN norms m ON m.chunk_id = c.chunk_id
  GROUP BY c.chunk_id
)"""
    if name == "vectors":
        return plain
    for part in ("word_rows", "bucket_rows", "norms", "vectors"):
        plain = re.sub(rf"\b{part}\b", f"{name}_{part}" if part != "vectors" else name, plain)
    return plain


def text_batch(boosts: dict[str, float], rows: str, asked: str = "asked", name: str = "batch_text") -> str:
    """CTE ``name(query_id, chunk_id, score)``: best boosted field of ``rows`` for each ``asked (query_id, content)``."""
    fields = " UNION ALL ".join(
        f"SELECT chunk_id, '{f}' AS field, {b}::DOUBLE AS boost, {tokens(f)} AS tok FROM {rows}" for f, b in boosts.items())
    return f""",
{name}_t AS ({fields}),
{name}_p AS (
  SELECT chunk_id, field, boost, term, count(*)::DOUBLE AS tf, any_value(dl) AS dl
  FROM (SELECT chunk_id, field, boost, unnest(tok) AS term, len(tok)::DOUBLE AS dl FROM {name}_t) GROUP BY ALL),
{name}_m AS (SELECT field, count(*)::DOUBLE AS n, avg(len(tok)) AS mean FROM {name}_t WHERE len(tok) > 0 GROUP BY field),
{name}_d AS (SELECT field, term, count(*)::DOUBLE AS df FROM {name}_p GROUP BY field, term),
{name}_a AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({tokens('content')}) AS term FROM {asked}) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, chunk_id, field, sum(boost * weight * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
         * tf / (tf + {C.BM25_K1}::DOUBLE * (1.0::DOUBLE - {C.BM25_B}::DOUBLE + {C.BM25_B}::DOUBLE * dl / mean))) AS score
  FROM {name}_a JOIN {name}_p USING (term) JOIN {name}_d USING (field, term) JOIN {name}_m USING (field) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, max(score) AS score FROM {name}_s GROUP BY ALL)"""


def similarity(col: str, query: list[float]) -> str:
    probe = "[" + ", ".join(repr(v) for v in query) + "]::DOUBLE[]"
    cosine = f"list_cosine_similarity({col}::DOUBLE[], {probe})"
    return f"(1.0::DOUBLE + CASE WHEN isnan({cosine}) THEN 0 ELSE {cosine} END) / 2.0::DOUBLE"


def bm25(query: str, boosts: dict[str, float], rows: str = "chunks", name: str = "text_scores") -> str:
    """CTE ``name(chunk_id, text_score)`` of the best boosted field score."""
    asked = query_terms(query)
    parts = []
    for field, boost in boosts.items():
        terms = " UNION ALL ".join(
            f"SELECT chunk_id, len(list_filter(tok, lambda w: w = {text(t)}))::DOUBLE AS tf, dl, {weight}::DOUBLE AS weight, {text(t)} AS term FROM t_{name}_{field}"
            for t, weight in asked.items()
        )
        parts.append(f"""
t_{name}_{field} AS (SELECT chunk_id, tok, len(tok)::DOUBLE AS dl FROM (SELECT chunk_id, {tokens(field)} AS tok FROM {rows})),
m_{name}_{field} AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM t_{name}_{field} WHERE dl > 0),
h_{name}_{field} AS ({terms}),
d_{name}_{field} AS (SELECT term, count(*)::DOUBLE AS df FROM h_{name}_{field} WHERE tf > 0 GROUP BY term),
s_{name}_{field} AS (
  SELECT chunk_id, {boost}::DOUBLE * sum(weight * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
         * tf / (tf + {C.BM25_K1}::DOUBLE * (1.0::DOUBLE - {C.BM25_B}::DOUBLE + {C.BM25_B}::DOUBLE * dl / mean))) AS score
  FROM h_{name}_{field} h JOIN d_{name}_{field} d USING (term), m_{name}_{field} WHERE tf > 0 GROUP BY chunk_id
)""")
    union = " UNION ALL ".join(f"SELECT chunk_id, score FROM s_{name}_{f}" for f in boosts)
    return "," + ",".join(parts) + f""",
{name} AS (SELECT chunk_id, max(score) AS text_score FROM ({union}) GROUP BY chunk_id)"""


def hybrid(query: str, fetch: int, weights: tuple[float, float], name: str = "hybrid", where: str = "", pad: bool = False) -> str:
    """CTE ``name(chunk_id, article_id, score)`` of matched rows (after ``vectors``)."""
    vector_weight, text_weight = weights
    probe = embed_text(query)
    matched = "TRUE" if pad else "(n.chunk_id IS NOT NULL OR coalesce(t.text_score, 0) > 0)"
    return bm25(query, C.FIELD_BOOSTS, name=f"{name}_text") + f""",
{name}_near AS (
  SELECT chunk_id, {similarity('content_vector', probe)} AS near FROM vectors
  ORDER BY near DESC, chunk_id LIMIT {fetch}
),
{name} AS (
  SELECT c.chunk_id, c.article_id, c.category, c.is_exclusive,
         CASE WHEN n.chunk_id IS NOT NULL THEN n.near * {vector_weight}::DOUBLE ELSE 0 END
         + coalesce(t.text_score, 0) * {text_weight}::DOUBLE AS score
  FROM chunks c LEFT JOIN {name}_near n USING (chunk_id) LEFT JOIN {name}_text t USING (chunk_id)
  WHERE {matched} {where}
)"""


EVENTS = """
rows AS (
  SELECT user_id::VARCHAR AS article_id, user_id || '_' || event_id AS chunk_id, event_id::INT AS chunk_index,
         event_type AS category, value > 50 AS is_exclusive, ts AS published_at, value
  FROM events
)"""


def collapsed(source: str, limit: int | None = None, name: str = "newest") -> str:
    cut = "" if limit is None else f" ORDER BY published_at DESC NULLS LAST, article_id LIMIT {limit}"
    return f""",
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY published_at DESC NULLS LAST, chunk_index, chunk_id) AS rn
  FROM {source}
),
{name} AS (
  SELECT * EXCLUDE (rn) FROM {name}_ranked WHERE rn = 1{cut}
)"""
