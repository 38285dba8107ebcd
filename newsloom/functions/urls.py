"""URL clean-up, identifiers, categories and the article-link test."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom import constants as C

# scheme, authority (with its slashes), path; query and fragment are not kept
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def url_path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def url_host(url: Column) -> Column:
    return F.substring(_part(url, 2), 3, 1 << 30)


def normalize_url(url: Column) -> Column:
    """Drop query, fragment, parameters and trailing slashes; lower the scheme."""
    scheme = F.lower(_part(url, 1))
    prefix = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    return F.concat(prefix, _part(url, 2), F.regexp_replace(url_path(url), r"/+$", ""))


def article_id(url: Column) -> Column:
    return F.md5(normalize_url(url))


def short_id(url: Column) -> Column:
    return F.substring(article_id(url), 1, 12)


def chunk_id(article: Column, index: Column) -> Column:
    return F.concat_ws("_", article, index.cast("string"))


def slug(url: Column) -> Column:
    """Word characters and dashes of the last path segment, at most 80."""
    path = F.regexp_replace(url_path(url), r"/+$", "")
    last = F.regexp_extract(path, r"[^/]*$", 0)
    return F.substring(F.regexp_replace(last, r"(?U)[^\w\-]", ""), 1, C.MAX_SLUG_CHARS)


def file_name(url: Column) -> Column:
    return F.concat(slug(url), F.lit(".json"))


def infer_category(url: Column) -> Column:
    """Category of the first rule whose fragment occurs anywhere in the URL."""
    lowered = F.lower(url)
    (fragment, category), *rest = C.CATEGORY_RULES
    chain = F.when(lowered.contains(fragment), category)
    for fragment, category in rest:
        chain = chain.when(lowered.contains(fragment), category)
    return chain.otherwise(C.DEFAULT_CATEGORY)


def is_article_url(url: Column, domain: str | list[str]) -> Column:
    """Host empty or ending in a site domain, no excluded fragment, two path parts."""
    domains = [domain] if isinstance(domain, str) else list(domain)
    host = url_host(url)
    on_site = host == ""
    for suffix in domains:
        on_site = on_site | host.endswith(suffix)
    lowered = F.lower(url)
    excluded = F.lit(False)
    for fragment in C.NON_ARTICLE_FRAGMENTS:
        excluded = excluded | lowered.contains(fragment)
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    return on_site & ~excluded & (F.size(parts) >= 2)


def absolute_url(href: Column, origin: Column | str) -> Column:
    base = F.lit(origin) if isinstance(origin, str) else origin
    return F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)


def unix_path(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))


# --- link titles -------------------------------------------------------------

def has_exclusive_prefix(text: Column) -> Column:
    return text.rlike(r"(?i)^(EXCLUSIVE|EXCL:)")


def strip_exclusive_prefix(text: Column) -> Column:
    from newsloom.functions.text import strip

    cut = F.regexp_replace(text, r"(?iU)^(?:EXCLUSIVE\s*\n?\s*|EXCL:\s*)", "")
    return strip(F.when(has_exclusive_prefix(text), cut).otherwise(text))


def link_priority(text: Column) -> Column:
    return F.when(has_exclusive_prefix(text), 0).otherwise(1)
