"""Fields of a page by its elements: one pass over the tags with a stack of open elements.

Where :mod:`newsloom.functions.html` cuts with regular expressions, an element
here ends at its own closing tag however deep it nests elements of its name.  The
pass is linear in the page, runs in Arrow batches and needs no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from newsloom.functions import html as H

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<[!?/][^<>]*>")
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z\-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BY = re.compile(r"^By\s+", re.I)
SPACE = " \t\n\r\f\v"

#: Elements without content, and those that end an open paragraph or keep it from being ended.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("button caption html object table td th".split())

FIELDS = ("headline string, subtitle string, author string, published_at string, content string,"
          " layout int, paragraphs int, is_exclusive boolean")


class Element:
    """An element in page order; ``text`` is whole once the page has been read."""

    __slots__ = ("name", "attributes", "in_article", "start", "text")

    def __init__(self, name: str, attributes: dict[str, str], in_article: bool, start: int):
        self.name, self.attributes, self.in_article, self.start = name, attributes, in_article, start
        self.text = ""


def _attributes(source: str) -> dict[str, str]:
    if "=" not in source:
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def _wanted(name: str, attributes: dict[str, str]) -> bool:
    return (name in ("h1", "time", "p") or "data-testid" in attributes
            or "breadcrumb" in attributes.get("class", "") or "aria-label" in attributes)


def visible(fragment: str) -> str:
    """Text as shown: references decoded, no white space at the ends."""
    return entities.unescape(fragment).replace("\xa0", " ").strip(SPACE)


def elements(page: str) -> list[Element]:
    """The elements a field can come from, in page order.

    A closing tag ends the nearest open element of its name and all that is open
    inside; one without such an element is passed over.  A paragraph also ends
    where a block begins, and everything ends with the page.
    """
    found: list[Element] = []
    parts: list[str] = []
    stack: list[tuple[str, Element | None]] = []
    opened: dict[str, int] = {}
    article = 0          # place in the stack behind the first article, 0 outside of it
    seen_article = False

    def close_from(at: int) -> None:
        nonlocal article
        while len(stack) > at:
            name, element = stack.pop()
            opened[name] -= 1
            if element is not None:
                element.text = visible("".join(parts[element.start:]))
        if article > at:
            article = 0

    at = 0
    for tag in TAG.finditer(page):
        if tag.start() > at:
            parts.append(page[at:tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if opened.get(name):
                close_from(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name == "br":
            parts.append("\n")
        if name in BLOCKS and opened.get("p"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close_from(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        attributes = _attributes(tag[3])
        element = Element(name, attributes, article > 0, len(parts)) if _wanted(name, attributes) else None
        if element is not None:
            found.append(element)
        if name in VOID or tag[3].endswith("/"):
            continue
        stack.append((name, element))
        opened[name] = opened.get(name, 0) + 1
        if name == "article" and not seen_article:
            article, seen_article = len(stack), True
    parts.append(page[at:])
    close_from(0)
    return found


def _good(texts: list[str]) -> list[str]:
    return [t for t in texts if len(t) > H.SHORT_PARAGRAPH and "Advertisement" not in t]


def _plain(texts: list[str]) -> list[str]:
    return [t for t in texts if len(t) > H.FALLBACK_PARAGRAPH and not t.startswith(H.FALLBACK_BANNED_START)
            and not any(word in t for word in H.FALLBACK_BANNED)]


def fields(page: str | None) -> tuple:
    """Values of :data:`FIELDS` of one page; a null page has empty fields."""
    found = elements(page or "")

    def marked(*values: str) -> list[Element]:
        return [e for e in found if e.attributes.get("data-testid") in values]

    def first(candidates: list[Element], tag: str | None = None) -> str:
        candidates = candidates or [e for e in found if e.name == tag]
        return candidates[0].text if candidates else ""

    layouts = [
        _good([e.text for e in marked("paragraph")]),
        _good([e.text for e in found if e.name == "p" and e.attributes.get("data-type") == "paragraph"]),
    ]
    layouts.append([] if any(len(t) > H.ENOUGH_PARAGRAPHS for t in layouts)
                   else _plain([e.text for e in found if e.name == "p" and e.in_article]))
    layout = next((k for k, t in enumerate(layouts) if len(t) > H.ENOUGH_PARAGRAPHS), 2)
    crumbs = [e for e in found if "breadcrumb" in e.attributes.get("class", "")][:1]
    exclusive = (any("exclusive" in e.attributes.get("aria-label", "").lower() for e in found)
                 or any("exclusive" in e.text.lower() for e in marked("content-tag", "content-tag-flashline") + crumbs))
    return (first(marked("headline"), "h1"), first(marked("dek-block")),
            BY.sub("", first(marked("byline"))).strip(SPACE), first(marked("timestamp-text"), "time"),
            "\n\n".join(layouts[layout]), layout + 1, len(layouts[layout]), exclusive)


def page_fields(html: Column) -> Column:
    """Struct of :data:`FIELDS`; scripts, styles and comments are passed over."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield pd.DataFrame([fields(p) for p in pages], columns=names)

    return read(H.without_noise(html))
