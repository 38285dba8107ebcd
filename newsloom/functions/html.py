"""Fields, links and element counts of a raw web page, as column expressions.

A page is cut with regular expressions rather than parsed into a tree: every
field the extractor needs is the text of one element or of a list of sibling
elements, and the expressions stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.text import let, strip

NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"

# --- fixed values: entities that are decoded; "&amp;" comes last ---------------
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"),
    ("&ldquo;", "“"), ("&hellip;", "…"), ("&amp;", "&"),
]

# --- fixed values: tags counted by the page profile ----------------------------
PROFILE_TAGS = [
    "h1", "h2", "h3", "h4", "h5", "p", "a", "div", "span", "article", "section",
    "nav", "header", "footer", "ul", "li", "figure", "img", "time", "button",
]
INFO_TAGS = ["h1", "h2", "h3", "h4", "p", "a", "div", "article", "section"]

# --- fixed values: paragraph rules of the three page layouts -------------------
SHORT_PARAGRAPH = 20
FALLBACK_PARAGRAPH = 30
FALLBACK_BANNED = ["Advertisement", "copyright", "Subscriber Agreement"]
FALLBACK_BANNED_START = "Write to "
ENOUGH_PARAGRAPHS = 2


def without_noise(html: Column) -> Column:
    return F.regexp_replace(html, NOISE, "")


def inner_text(fragment: Column) -> Column:
    """Visible text: breaks become newlines, tags vanish, entities are decoded."""
    text = F.regexp_replace(fragment, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first ``<tag>``; empty string when there is none."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def element_with(html: Column, attribute: str, value: str) -> Column:
    """Inner HTML of the first element whose attribute has exactly this value."""
    pattern = rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*\b{attribute}=["']{value}["'][^>]*>(.*?)</\1\s*>"""
    return F.regexp_extract(html, pattern, 2)


def elements_with(html: Column, tag: str, attribute: str, value: str) -> Column:
    """Inner HTML of each such element, split on the opening tag so that an
    unclosed element ends where the next one starts."""
    opening = rf"""(?is)<{tag}\b[^>]*\b{attribute}=["']{value}["'][^>]*>"""
    pieces = F.split(html, opening, -1)
    after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(after, lambda x: F.regexp_replace(x, r"(?is)</(p|article|section|div)\s*>.*$", ""))


def title_tag(html: Column) -> Column:
    return inner_text(element(html, "title"))


def headline(html: Column) -> Column:
    marked = inner_text(element_with(html, "data-testid", "headline"))
    return F.coalesce(F.nullif(marked, F.lit("")), inner_text(element(html, "h1")))


def subtitle(html: Column) -> Column:
    return inner_text(element_with(html, "data-testid", "dek-block"))


def byline(html: Column) -> Column:
    return strip(F.regexp_replace(inner_text(element_with(html, "data-testid", "byline")), r"(?i)^By\s+", ""))


def timestamp_text(html: Column) -> Column:
    marked = inner_text(element_with(html, "data-testid", "timestamp-text"))
    return F.coalesce(F.nullif(marked, F.lit("")), inner_text(element(html, "time")))


def article_paragraphs(html: Column) -> Column:
    """Text of every ``<p>`` in the first ``<article>``, closed or not."""
    body = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)", 1)
    pieces = F.split(body, r"(?is)<p(?:\s[^>]*)?>", -1)
    after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(after, lambda x: inner_text(F.regexp_replace(x, r"(?is)</p\s*>.*$", "")))


def keep_paragraphs(texts: Column) -> Column:
    """Paragraph rule of the two marked-up layouts."""
    return F.filter(texts, lambda t: (F.length(t) > SHORT_PARAGRAPH) & ~t.contains("Advertisement"))


def keep_fallback_paragraphs(texts: Column) -> Column:
    """Paragraph rule of the plain ``article p`` layout."""
    def good(t: Column) -> Column:
        ok = (F.length(t) > FALLBACK_PARAGRAPH) & ~t.startswith(FALLBACK_BANNED_START)
        for word in FALLBACK_BANNED:
            ok = ok & ~t.contains(word)
        return ok

    return F.filter(texts, good)


def body_text(html: Column) -> Column:
    """Article text from the first layout that yields more than two paragraphs."""
    marked = keep_paragraphs(F.transform(elements_with(html, r"[a-z][a-z0-9]*", "data-testid", "paragraph"), inner_text))
    typed = keep_paragraphs(F.transform(elements_with(html, "p", "data-type", "paragraph"), inner_text))
    plain = keep_fallback_paragraphs(article_paragraphs(html))
    enough = lambda texts: F.size(texts) > ENOUGH_PARAGRAPHS
    chosen = let(marked, lambda first: F.when(enough(first), first).otherwise(
        let(typed, lambda second: F.when(enough(second), second).otherwise(plain))
    ))
    return F.array_join(chosen, "\n\n")


def is_exclusive(html: Column) -> Column:
    """Any of: aria label, content tag or breadcrumb that says "exclusive"."""
    word = r"(?i)exclusive"
    tags = F.filter(
        F.concat(
            elements_with(html, r"[a-z][a-z0-9]*", "data-testid", "content-tag"),
            elements_with(html, r"[a-z][a-z0-9]*", "data-testid", "content-tag-flashline"),
        ),
        lambda x: F.regexp_replace(x, r"(?s)</.*$", "").rlike(word),
    )
    crumb = F.regexp_extract(html, r"""(?is)<([a-z][a-z0-9]*)\b[^>]*class=["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</\1\s*>""", 2)
    return (
        html.rlike(r"""(?i)aria-label=["'][^"']*exclusive""")
        | (F.size(tags) > 0)
        | inner_text(crumb).rlike(word)
    )


def anchors(html: Column, inside: str | None = "h3") -> Column:
    """``array<struct<pos, href, text>>`` of links, by default those in ``<h3>``."""
    if inside:
        blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<{inside}\b[^>]*>(.*?)</{inside}\s*>"), 1)
        html = F.array_join(blocks, "\n")
    whole = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*\bhref=["'][^"']*["'][^>]*>.*?</a\s*>"""), 0)
    return F.transform(whole, lambda a, i: F.struct(
        i.alias("pos"),
        F.regexp_extract(a, r"""(?is)\bhref=["']([^"']*)["']""", 1).alias("href"),
        inner_text(a).alias("text"),
    ))


def tag_names(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), F.lower)


def tag_counts(html: Column, tags: list[str]) -> Column:
    """``array<struct<tag, n>>`` of the listed tags that occur, in list order."""
    listed = F.array(*[F.lit(t) for t in tags])
    counted = let(tag_names(html), lambda names: F.transform(
        listed, lambda t: F.struct(t.alias("tag"), F.size(F.filter(names, lambda n: n == t)).alias("n"))
    ))
    return F.filter(counted, lambda c: c["n"] > 0)


def attribute_values(html: Column, attribute: str) -> Column:
    """The values of an attribute, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"""(?i)\s{attribute}=["']([^"']*)["']"""), 1)


def attribute_counts(html: Column, attribute: str) -> Column:
    """``array<struct<value, n>>`` of an attribute's values, alphabetical."""
    return let(attribute_values(html, attribute), lambda found: F.transform(
        F.array_sort(F.array_distinct(found)),
        lambda v: F.struct(v.alias("value"), F.size(F.filter(found, lambda x: x == v)).alias("n")),
    ))


def element_samples(html: Column, tag: str, limit: int = 10, chars: int = 80) -> Column:
    """Texts of the first ``limit`` elements, newlines flattened, cut to ``chars``."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), 1)
    return F.transform(
        F.slice(found, 1, limit),
        lambda x: F.replace(F.substring(inner_text(x), 1, chars), F.lit("\n"), F.lit(" ")),
    )


def attribute_samples(html: Column, tag: str, limit: int = 5, chars: int = 60) -> Column:
    """Attributes of the first ``limit`` elements as ``name=value``, values cut."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(\s[^>]*)>"), 1)
    pairs = lambda a: F.regexp_extract_all(a, F.lit(r"""([a-zA-Z\-]+)=["']([^"']*)["']"""), 0)

    def shorten(pair: Column) -> Column:
        name = F.regexp_extract(pair, r"^([^=]+)=", 1)
        value = F.regexp_extract(pair, r"""(?s)^[^=]+=["'](.*)["']$""", 1)
        cut = F.when(F.length(value) > chars, F.concat(F.substring(value, 1, chars), F.lit("..."))).otherwise(value)
        return F.concat(name, F.lit("="), cut)

    return F.transform(F.slice(found, 1, limit), lambda a: F.array_join(F.transform(pairs(a), shorten), " "))
