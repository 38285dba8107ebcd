"""Main text of pages: what a site repeats is its template, what is left is the article.

Pages are parsed into element trees.  Every element outside the article, and every
structural one inside it, is hashed twice: with its text (``content``) and without,
equal neighbours taken as one (``skeleton``).  Spark counts for each host how many
pages have a hash.  Pages are told apart by the longest block beside the element, so
an article published under many addresses counts once and its paragraphs do not look
like a template.  A subtree is deleted

* if its content stands on more than ``RATIO`` of the host's pages, ``LEAST_PAGES`` at least;
* if its skeleton does, and it is outside the page's ``article`` or mostly links.

Elements that name their role (``nav``, ``class="cookie-notice"`` …) go even where a
host has too few pages to tell, and so does all that stands beside an ``article``.
Plain paragraphs, headings, lists and tables of the article are the author's own:
a passage that many articles of a host share stays.

Counts are keyed by host, hash and longest block and combined in the map tasks, so a
host with a third of all pages is spread by its hashes.  The hashes to delete come
back as one list a host, bounded by the mean number of elements of a page divided by
``RATIO``.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import Batches, map_arrow, small_batches, table, written
from newsloom.llm.url_filter import host_of

RATIO = 0.3
LEAST_PAGES = 4
#: Key under which the pages of a host are counted.
ALL_PAGES = 0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre section summary table "
    "tbody td template tfoot th thead title tr ul".split())
#: Elements that carry running text rather than structure.
PLAIN = frozenset(
    "a abbr b bdi bdo big blockquote br cite code data dd del dfn dl dt em figcaption figure font h1 h2 h3 h4 h5 h6 i img ins "
    "kbd li mark ol p pre q s samp small span strike strong sub sup table tbody td tfoot th thead time tr tt u ul var".split())
FURNITURE = frozenset(
    "aside button canvas dialog footer form head header iframe menu nav noembed noframes noscript object script select style "
    "svg template textarea title".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination paywall popup popular promo promoted promotion "
    "recommended recommendations related respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser teasers toolbar widget".split())
NEGATIONS = frozenset("has no with without".split())
FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: An open element of the first kind ends where the second opens, unless one of the third was opened between.
ENDS_AT = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
P_ROOM = frozenset("button caption object table td th".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>?)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def names_furniture(attributes: dict[str, str]) -> bool:
    """Whether class, id or role name something other than an article."""
    if "hidden" in attributes or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAME_WORDS.findall(token)]
        if words and NEGATIONS.isdisjoint(words) and (words[0] in FURNITURE_WORDS or words[-1] in FURNITURE_WORDS):
            return True
    return False


class Tree:
    """Elements of a page in the order they open; children of ``i`` are ``i + 1`` to ``end[i]``.

    ``pieces`` has the text in page order as (element, text), with None for the
    text where a block begins or ends.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.named = ["#page"], [-1], [0], [False]
        self.label = [b""]
        self.pieces: list[tuple[int, str | None]] = []
        self._open, self._count = [0], Counter()
        self._read(source)
        while len(self._open) > 1:
            self._pop()
        self.end[0] = len(self.tag)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            self._text(source[at:found.start() if found else size])
            if not found:
                return
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
                continue
            self._start(tag, found[3])
            if tag in RAW and self._open[-1] and self.tag[self._open[-1]] == tag:
                over = re.compile(rf"</{tag}(?![a-z0-9])[^>]*>?", re.I).search(source, at)
                at = over.end() if over else size
                self._pop()

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._open[-1], entities.unescape(text) if "&" in text else text))

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCK and self._count["p"]:
            self._end_open({"p"}, P_ROOM)
        if tag in ENDS_AT:
            kinds, room = ENDS_AT[tag]
            if any(self._count[k] for k in kinds):
                self._end_open(kinds, room)
        top = self._open[-1]
        if tag == "br":
            self.pieces.append((top, " "))
        if tag in BLOCK:
            self.pieces.append((top, None))
        if tag in VOID:
            return
        attributes = {}
        if len(rest) > 1:
            for name, value in ATTRIBUTE.findall(rest):
                attributes.setdefault(name.lower(), value.strip("\"'"))
        self.tag.append(tag)
        self.parent.append(top)
        self.end.append(0)
        self.named.append(bool(attributes) and tag not in ("html", "body") and names_furniture(attributes))
        self.label.append(f"{tag} {attributes.get('class', '')} {attributes.get('id', '')}".encode())
        self._open.append(len(self.tag) - 1)
        self._count[tag] += 1

    def _end_open(self, kinds: set[str], room: frozenset[str] | set[str]) -> None:
        """End the outermost open element of ``kinds`` above the innermost of ``room``."""
        last = None
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in room:
                break
            if tag in kinds:
                last = depth
        if last is not None:
            while len(self._open) > last:
                self._pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self.pieces.append((self._open[-1], None))
        if not self._count[tag]:
            return
        if tag not in BLOCK:  # text after an inline end tag stays in the block it is in
            for element in reversed(self._open):
                if self.tag[element] == tag:
                    break
                if self.tag[element] in BLOCK:
                    return
        while self.tag[self._pop()] != tag:
            pass

    def _pop(self) -> int:
        element = self._open.pop()
        self.end[element] = len(self.tag)
        self._count[self.tag[element]] -= 1
        if self.tag[element] in BLOCK:
            self.pieces.append((self.parent[element], None))
        return element


class Page:
    """A parsed page with its article, its furniture and the hashes of its elements."""

    def __init__(self, source: str):
        self.tree = tree = Tree(source)
        n = len(tree.tag)
        self.text_size, self.link_size, self.linked = [0] * n, [0] * n, [False] * n
        self._measure()
        self._find_article()
        self.marked = [self._is_furniture(i) for i in range(n)]

    def _measure(self) -> None:
        tree = self.tree
        for i in range(1, len(tree.tag)):
            self.linked[i] = tree.tag[i] == "a" or self.linked[tree.parent[i]]
        for i, text in tree.pieces:
            if text:
                size = len(text) - text.count(" ")
                self.text_size[i] += size
                self.link_size[i] += size if self.linked[i] else 0
        self.own_size = list(self.text_size)
        for i in range(len(tree.tag) - 1, 0, -1):
            self.text_size[tree.parent[i]] += self.text_size[i]
            self.link_size[tree.parent[i]] += self.link_size[i]

    def _find_article(self) -> None:
        """Roots of the article: ``article`` elements, else ``main``, else what holds most running text."""
        tree = self.tree
        n = len(tree.tag)
        within, under, in_main = [False] * n, [False] * n, [False] * n
        found: dict[str, list[int]] = {"article": [], "main": []}
        covered: dict[str, list[int]] = {"article": [], "main": []}
        for i in range(1, n):
            up = tree.parent[i]
            under[i] = under[up] or tree.named[i] or (tree.tag[i] in FURNITURE and not (tree.tag[i] == "header" and in_main[up]))
            in_main[i] = in_main[up] or tree.tag[i] in ("article", "main")
            within[i] = within[up]
            kind = tree.tag[i]
            if kind in found and not tree.named[i]:
                if not under[i]:
                    if not (kind == "article" and within[i]):
                        found[kind].append(i)
                    within[i] = within[i] or kind == "article"
                else:
                    covered[kind].append(i)
        self.in_main = in_main
        roots = found["article"] or found["main"]
        if not roots:
            named = covered["article"] or covered["main"]
            roots = [max(named, key=lambda i: (self.text_size[i], -i))] if named else []
        self.explicit = bool(roots)
        if not roots:
            mass = Counter()
            for clean in (True, False):  # furniture only where nothing else has text
                for i in range(n):
                    if self.own_size[i] and not self.linked[i] and not (clean and under[i]):
                        j = i
                        while tree.tag[j] in PLAIN:
                            j = tree.parent[j]
                        mass[j] += self.own_size[i]
                if mass:
                    break
            roots = [max(mass, key=lambda i: (mass[i], -i))] if mass else [0]
        self.roots = roots
        self.inside, self.holds = [False] * n, [False] * n
        for root in roots:
            for i in range(root, tree.end[root]):
                self.inside[i] = True
            while root >= 0 and not self.holds[root]:
                self.holds[root] = True
                root = tree.parent[root]

    def _is_furniture(self, i: int) -> bool:
        tag = self.tree.tag[i]
        if self.holds[i]:
            return False
        return self.tree.named[i] or (tag in FURNITURE and not (tag == "header" and self.in_main[self.tree.parent[i]]))

    def _hashes(self) -> tuple[list[int], list[int]]:
        tree = self.tree
        n = len(tree.tag)
        whole: list[list[bytes]] = [[] for _ in range(n)]
        shape: list[list[int]] = [[] for _ in range(n)]
        texts: list[list[tuple[int, bytes]]] = [[] for _ in range(n)]
        for k, (i, text) in enumerate(tree.pieces):
            if text and not text.isspace():
                texts[i].append((k, " ".join(text.split()).encode("utf-8", "replace")))
        content, skeleton = [0] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            children[i].reverse()
            whole[i] = [tree.label[i], *(t for _, t in texts[i]), *(content[c].to_bytes(8, "big", signed=True) for c in children[i])]
            content[i] = digest(b"c\0" + b"\0".join(whole[i]))
            for c in children[i]:
                if not shape[i] or shape[i][-1] != skeleton[c]:
                    shape[i].append(skeleton[c])
            skeleton[i] = digest(b"s\0" + tree.label[i] + b"\0" + b"".join(s.to_bytes(8, "big", signed=True) for s in shape[i]))
            if i:
                children[tree.parent[i]].append(i)
        return content, skeleton

    def _countable(self, i: int) -> bool:
        """Elements that may be template: not around the article, and no running text within it."""
        return not self.holds[i] and bool(self.text_size[i]) and not (self.inside[i] and self.tree.tag[i] in PLAIN)

    def blocks(self) -> Iterator[tuple[int, str]]:
        """Every block inside the article roots with its first element."""
        first, parts = -1, []
        for i, text in self.tree.pieces:
            if text is None:
                line = " ".join("".join(parts).split())
                if line:
                    yield first, line
                first, parts = -1, []
            elif self.inside[i]:
                first = i if first < 0 else first
                parts.append(text)
        line = " ".join("".join(parts).split())
        if line:
            yield first, line

    def counted(self) -> set[tuple[int, int]]:
        """(hash, longest block beside the element) of everything that may be template, and of the page."""
        content, skeleton = self._hashes()
        blocks = sorted(((len(t), digest(t.encode("utf-8", "replace")), i) for i, t in self.blocks()), reverse=True)
        out = {(ALL_PAGES, blocks[0][1] if blocks else 0)}
        for i in range(1, len(content)):
            if self._countable(i):
                beside = next((h for _, h, at in blocks if not i <= at < self.tree.end[i]), 0)
                out.add((content[i], beside))
                out.add((skeleton[i], beside))
        return out

    def main_text(self, template: frozenset[int]) -> tuple[str, int]:
        """Blocks that stay, and how many subtrees went because the site repeats them."""
        tree = self.tree
        n = len(tree.tag)
        gone, deleted = [False] * n, 0
        content, skeleton = self._hashes() if template else ([], [])
        for i in range(1, n):
            gone[i] = gone[tree.parent[i]]
            if gone[i]:
                continue
            if template and self._countable(i):
                beside = self.explicit and not self.inside[i]
                if content[i] in template or (
                        skeleton[i] in template and (beside or 2 * self.link_size[i] >= self.text_size[i])):
                    gone[i] = True
                    deleted += 1
                    continue
            gone[i] = self.marked[i]
        lines, parts = [], []
        for i, text in [*tree.pieces, (0, None)]:
            if text is None:
                line = " ".join("".join(parts).split())
                if line:
                    lines.append(line)
                parts = []
            elif not gone[i] and (self.inside[i] or not self.explicit):
                parts.append(text)
        return "\n".join(lines), deleted


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]


def _count(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        host, key, beside = [], [], []
        for name, source in zip(*_columns(batch, "host", "html")):
            for k, b in Page(source or "").counted():
                host.append(name)
                key.append(k)
                beside.append(b)
        yield {"host": host, "key": key, "beside": beside}


def _extract(batches: Batches) -> Iterator[dict]:
    for batch in batches:
        text, deleted = [], []
        for source, template in zip(*_columns(batch, "html", "template")):
            t, d = Page(source or "").main_text(frozenset(template or ()))
            text.append(t)
            deleted.append(d)
        yield {"page_id": batch.column(batch.schema.get_field_index("page_id")),
               "url": batch.column(batch.schema.get_field_index("url")), "text": text, "n_template": deleted}


def templates(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, template``: hashes of the subtrees each host repeats, hosts without any left out."""
    small_batches(pages.sparkSession)
    marks = map_arrow(pages.select(host_of(F.col("url")).alias("host"), "html"), _count, "host string, key long, beside long")
    counts = written(marks.distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
                     .filter((F.col("key") == ALL_PAGES) | (F.col("n") >= least_pages)), "page-subtrees")
    hosts = counts.filter(F.col("key") == ALL_PAGES).select("host", F.col("n").alias("of"))
    return (counts.filter(F.col("key") != ALL_PAGES).join(hosts, "host").filter(F.col("n") > ratio * F.col("of"))
            .groupBy("host").agg(F.collect_list("key").alias("template")))


def main_texts(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars, n_template`` of every row of ``pages (page_id, url, html)``.

    ``text`` has the blocks that stay, one a line, character references decoded and
    white space inside a block made one space; ``n_template`` is the number of
    subtrees that went because the host repeats them.  Null html is empty, and an
    empty page has an empty text.  Null urls and urls without a host are one site
    with an empty name.  Rows that repeat an id or a whole page are pages each.
    Other columns, whatever their names, are not looked at; an empty table gives an
    empty result.  Very long pages are read whole, in time in proportion to length.
    """
    named = pages.select("page_id", "url", "html")
    known = written(templates(named, ratio, least_pages), "page-templates")
    joined = (named.withColumn("host", host_of(F.col("url"))).join(known, "host", "left")
              .select("page_id", "url", "html", "template"))
    ids = named.schema["page_id"].dataType.simpleString()
    texts = map_arrow(joined, _extract, f"page_id {ids}, url string, text string, n_template long")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
