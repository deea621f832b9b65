"""Operator 13, HTML extraction by composite text density (Sun, Song and Liao, 2011).

A page becomes a tree of elements with implied ends, kept as lists in page order, so that all sums
are loops over numbers and no page is too deep. Every node's density is its characters per tag,
adjusted by how many of its characters and tags are links. A container's sum of its children's
densities tells where the text is: the one with the largest sum is chosen. The least density on its
path to the body is the threshold for what stands beside that path. Menus, footers, adverts,
comments and the like are left out by element, role and class name, wherever they are.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
).union(HEADINGS)
BLOCK = ENDS_P.union("body caption legend option tbody td tfoot th thead tr".split())
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "caption"}, {"table"}),
}
CONTAINERS = frozenset("body div section article main td center".split())
#: Never shown, or not text.
UNSEEN = frozenset("head title script style noscript template iframe noembed noframes xmp object svg canvas audio video datalist".split())
#: Not the article, whatever they hold; and unless they hold an article.
APART = frozenset("nav menu footer aside button select textarea dialog search".split())
APART_UNLESS = frozenset(["form"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class names and ids.
HEADER_WORDS = frozenset("header masthead topbar".split())
ARTICLE_WORDS = frozenset("article content entry page post story".split())
OTHER_WORDS = frozenset(
    """nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar footer sidebar sidebars aside widget widgets related recommended ad ads advert adverts
    advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner banners notice notices cookie cookies consent gdpr alert popup modal overlay
    paywall form newsletter subscribe subscription signup login search share sharing social copyright""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
DENIED = frozenset("has with no without".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?P<closed>>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SHOWN, NOT_SHOWN, OUTSIDE, OUTSIDE_UNLESS = 0, 1, 2, 3


def _words(name: str) -> set[str]:
    return {w.lower() for w in WORD.findall(name)}


class Page:
    """Elements in page order: a node's parent has a lower number. Node 0 is the body."""

    def __init__(self, html: str):
        self.tag, self.parent, self.kind = ["body"], [-1], [SHOWN]
        self.own = [0]  # characters right inside
        self.events: list[tuple[int, str | None]] = []  # texts, and None where a block begins or ends
        self.stack, self.open = [0], Counter({"body": 1})
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            found = TOKEN.search(html, at)
            if found is None:
                self._text(html[at:])
                return
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            if not found["closed"]:
                return  # the page ends inside a tag
            name = name.lower()
            if found["end"]:
                self._end(name)
            else:
                self._start(name, found["attributes"])
                if name in RAW:
                    last = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    if last is None:
                        return
                    at = last.start()

    def _text(self, text: str) -> None:
        if "&" in text:
            text = references.unescape(text)
        chars = len("".join(text.split()))
        if chars and self.open["head"]:
            self._pop_to("head")
        top = self.stack[-1]
        self.own[top] += chars
        self.events.append((top, text))

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[self.tag[node]] -= 1
        if self.tag[node] in BLOCK:
            self.events.append((node, None))

    def _pop_to(self, name: str) -> None:
        while self.tag[self.stack[-1]] != name:
            self._pop()
        self._pop()

    def _end_one(self, names: set[str], stop: set[str]) -> None:
        """Ends the innermost open element of these, unless one of ``stop`` is inside it."""
        if not any(self.open[n] for n in names):
            return
        for node in reversed(self.stack):
            if self.tag[node] in names:
                self._pop_to(self.tag[node])
                return
            if self.tag[node] in stop:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            if self.open["head"]:
                self._pop_to("head")
            return
        if self.open["head"] and name not in IN_HEAD:
            self._pop_to("head")
        if name in ENDS_P:
            self._end_one({"p"}, {"td", "th", "table", "button", "caption"})
        if name in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self._pop()
        if name in ENDS:
            self._end_one(*ENDS[name])
        top, node = self.stack[-1], len(self.tag)
        self.tag.append(name)
        self.parent.append(top)
        self.kind.append(self._kind_of(name, attributes))
        self.own.append(0)
        if name in BLOCK:
            self.events.append((node, None))
        if name == "br":
            self.events.append((top, " "))
        if name in ("article", "main") and self.kind[node] == SHOWN:
            for above in self.stack:
                if self.kind[above] == OUTSIDE_UNLESS:
                    self.kind[above] = SHOWN
        if name not in VOID:
            self.stack.append(node)
            self.open[name] += 1

    def _end(self, name: str) -> None:
        if name == "p" and not self.open["p"]:
            self.events.append((self.stack[-1], None))
        if name in ("html", "body") or not self.open[name]:
            return
        if name not in BLOCK:
            # An inline element that a block inside has not ended yet stays open.
            for node in reversed(self.stack):
                if self.tag[node] == name:
                    break
                if self.tag[node] in BLOCK:
                    return
        elif name not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th"):
            # What is left open outside a table can't be ended inside it.
            for node in reversed(self.stack):
                if self.tag[node] == name:
                    break
                if self.tag[node] == "table":
                    return
        self._pop_to(name)

    def _kind_of(self, name: str, attributes: str) -> int:
        if name in UNSEEN:
            return NOT_SHOWN
        if name in APART:
            return OUTSIDE
        within = self.open["article"] or self.open["main"]
        kind = OUTSIDE_UNLESS if name in APART_UNLESS or (name == "header" and not within) else SHOWN
        if not attributes or attributes.isspace():
            return kind
        given = {}
        for key, *value in ATTRIBUTE.findall(attributes):
            given.setdefault(key.lower(), "".join(value))
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or HIDDEN.search(given.get("style", "")):
            return NOT_SHOWN
        if name not in BLOCK:
            return kind
        if ROLES.intersection(given.get("role", "").lower().split()):
            return OUTSIDE
        for label in [*given.get("class", "").split(), given.get("id", "")]:
            words = _words(label)
            if words & DENIED:
                continue
            if words & COMMENT_WORDS:
                return OUTSIDE
            if words & OTHER_WORDS or (words & HEADER_WORDS and not within and not words & ARTICLE_WORDS):
                # Not an article's own name, as in class="post sponsored"; a wrapper is taken back when an article begins in it.
                kind = OUTSIDE if name in ("article", "main") else OUTSIDE_UNLESS
        return kind


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Characters per tag, times a logarithm of characters and tags per linked one, whose base grows with the linked share.

    Counts that divide are 1 at least, and the base is not below e, so that a page with hardly any link has
    densities that follow its text.
    """
    if not chars:
        return 0.0
    tags = max(tags, 1)
    gain = math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1))
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_share * chars + math.e)
    return chars / tags * max(gain, 0.0) / max(math.log(base), 1.0)


class Densities:
    """Sums over each node's subtree, densities, and the sums of the children's densities."""

    def __init__(self, page: Page):
        n = len(page.tag)
        self.unseen = [False] * n
        self.apart = [False] * n
        linked = [False] * n
        for i in range(n):
            up = page.parent[i]
            self.unseen[i] = page.kind[i] == NOT_SHOWN or (up >= 0 and self.unseen[up])
            self.apart[i] = page.kind[i] >= OUTSIDE or (up >= 0 and self.apart[up])
            linked[i] = page.tag[i] == "a" or (up >= 0 and linked[up])
        self.chars = [0 if self.unseen[i] else page.own[i] for i in range(n)]
        self.link_chars = [c if linked[i] else 0 for i, c in enumerate(self.chars)]
        self.article_chars = [0 if self.apart[i] else c for i, c in enumerate(self.chars)]
        self.tags, self.link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            up = page.parent[i]
            self.chars[up] += self.chars[i]
            self.link_chars[up] += self.link_chars[i]
            self.article_chars[up] += self.article_chars[i]
            self.tags[up] += self.tags[i] + (not self.unseen[i])
            self.link_tags[up] += self.link_tags[i] + (page.tag[i] == "a" and not self.unseen[i])
        share = self.link_chars[0] / max(self.chars[0], 1)
        self.density = [density(*x, share) for x in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True)]
        # Text right inside an element counts as one more child, which has no tags.
        self.sum = [0.0 if self.unseen[i] or linked[i] else density(page.own[i], 0, 0, 0, share) for i in range(n)]
        # What is apart is no part of a main text, however dense.
        for i in range(1, n):
            self.sum[page.parent[i]] += 0.0 if self.apart[i] else self.density[i]


def chosen(page: Page, found: Densities) -> list[bool]:
    """Which nodes have the main text."""
    n = len(page.tag)
    left_out = found.apart.copy()
    for i in range(n):
        up = page.parent[i]
        links = page.tag[i] in BLOCK and found.link_tags[i] >= 3 and found.link_chars[i] == found.chars[i]
        left_out[i] = left_out[i] or found.unseen[i] or links or (up >= 0 and left_out[up])
    within = [-1] * n  # the outermost article, else the outermost main element, that a node is in
    for i in range(n):
        up = page.parent[i]
        within[i] = within[up] if up >= 0 else -1
        if not left_out[i] and (page.tag[i] == "article" and (within[i] < 0 or page.tag[within[i]] == "main") or page.tag[i] == "main" and within[i] < 0):
            within[i] = i
    best = max((i for i in range(n) if page.tag[i] in CONTAINERS and not left_out[i]), key=lambda i: (found.sum[i], i), default=0)

    roots = {best}
    if within[best] >= 0 and page.tag[within[best]] == "article":
        roots = {within[best]}
    else:
        inside = [i == best for i in range(n)]
        for i in range(best + 1, n):
            inside[i] = inside[i] or (page.parent[i] >= 0 and inside[page.parent[i]])
        articles = {i for i in range(n) if inside[i] and within[i] == i and i != best}
        if articles and 2 * sum(found.article_chars[i] for i in articles) >= found.article_chars[best]:
            roots = articles
        else:
            path, up = set(), best
            while up >= 0 and (up == best or page.tag[up] != "main"):
                path.add(up)
                up = page.parent[up]
            least, beside = min(found.density[i] for i in path), path - {best}
            for i in range(n):
                if page.parent[i] in beside and i not in path and not left_out[i] and found.chars[i]:
                    heading = page.tag[i] in HEADINGS and i < best
                    if heading or (page.tag[i] in BLOCK and found.density[i] >= least):
                        roots.add(i)
    out = [False] * n
    for i in range(n):
        up = page.parent[i]
        out[i] = not left_out[i] and (i in roots or (up >= 0 and out[up]))
    return out


def main_text(html: str) -> str:
    """The text of the main part of a page: blocks in page order, an empty line between two."""
    page = Page(html)
    kept = chosen(page, Densities(page))
    blocks, pieces = [], []
    for node, text in [*page.events, (0, None)]:
        if text is not None:
            if kept[node]:
                pieces.append(text)
        elif pieces:
            if block := " ".join("".join(pieces).split()):
                blocks.append(block)
            pieces = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each row, then text and n_chars (code points).

    Character references are decoded; Unicode white space inside a block, and a line break, become one space;
    table cells and list items are blocks. Null and empty pages, and pages of markup only, have an empty text. A page
    that ends inside a tag or a comment ends there; end tags that are missing are implied. Repeated rows each get
    a row, an empty table gives none. A page has to fit the memory of a task; work is linear in its
    size. Other columns are not read. Nothing is shuffled.
    """
    picked = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_column}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"]
            )

    fields = picked.schema.fields[: len(keep)]
    return picked.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
