"""Main text of web pages by composite text density.

A page is read into a flat list of elements. For each, the characters per tag of its subtree are
weighted by how few of them are link text; an element's sum is that of its children's densities.
The element with the largest sum is the article, the smallest density between it and the body is
the threshold, and other subtrees at least that dense give their element of largest sum as well.
Elements that are boilerplate by tag, role or class take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Start tags that end an open element of these names.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
# Elements that such a search for an open element does not leave.
SCOPE = set("article aside blockquote body button div dl form main nav ol section table ul".split())

HEADLINES = {"h1", "h2", "h3", "h4", "h5", "h6"}

DROPPED = set(
    "script style noscript template iframe object embed svg math canvas head nav footer aside form "
    "button select textarea input menu dialog title audio video".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
COMMENTS = set("comment comments commentlist disqus reply replies respond discussion".split())
BOILERPLATE = COMMENTS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr "
    "notice notices notification popup modal newsletter subscribe signup login share sharing social "
    "related recommended recommendations widget toolbar pagination pager skip alert".split()
)
NEGATING = set("no has with without hide show".split())


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)
    }


def _is_boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    names = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", named).lower())
    found = {n for n, before in zip(names, ["", *names]) if before not in NEGATING}
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return bool(found & COMMENTS)
    return bool(found & BOILERPLATE) or "header" in found and not in_article


class Page:
    """Elements in page order; every element comes after its parent."""

    def __init__(self, html: str) -> None:
        self.tags, self.parent, self.dropped = ["html"], [-1], [False]
        self.parts: list[tuple[int, str | None]] = []  # element and text; None ends a block
        self._open = [0]
        self._articles = 0
        self._read(html)
        self._keep_articles()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            if m is None:
                self._text(unescape(html[at:]))
                return
            if m.start() > at:
                self._text(unescape(html[at : m.start()]))
            at = m.end()
            if m[1] is not None:
                self._text(m[1])
            elif m[3]:
                name = m[3].lower()
                if m[2]:
                    self._end(name)
                else:
                    self._start(name, m[4])
                    if name in RAW and not m[4].rstrip().endswith("/"):
                        close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                        at = close.start() if close else size

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            self.parts.append((self._open[-1], text))
        elif text:
            self.parts.append((self._open[-1], " "))

    def _break(self, name: str) -> None:
        if name in BLOCK:
            self.parts.append((self._open[-1], None))

    def _close(self, names: set[str], scope: set[str]) -> None:
        """Close the innermost open element of ``names``, unless one of ``scope`` is inside it."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in names:
                self._pop(k)
                return
            if tag in scope:
                return

    def _pop(self, k: int) -> None:
        for node in self._open[k:]:
            self._articles -= self.tags[node] in ("article", "main")
            if self.tags[node] in BLOCK:
                self.parts.append((self.parent[node], None))
        del self._open[k:]

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and name in (self.tags[n] for n in self._open[1:] or [0]):
            return
        if name == "html":
            return
        if name in ENDS_P:
            self._close({"p"}, SCOPE)
        if name in ENDS:
            self._close(ENDS[name], SCOPE)
        self._break(name)
        if name == "br":
            self.parts.append((self._open[-1], " "))
        node = len(self.tags)
        found = _attributes(attributes) if attributes.strip(" /\n\t\r") else {}
        self.tags.append(name)
        self.parent.append(self._open[-1])
        self.dropped.append(_is_boilerplate(name, found, self._articles > 0))
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
            self._open.append(node)
            self._articles += name in ("article", "main")

    def _end(self, name: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == name:
                self._pop(k)
                return

    def _keep_articles(self) -> None:
        """Boilerplate that holds an article of its own is a wrapper and stays."""
        for node in range(len(self.tags) - 1, 0, -1):
            if self.tags[node] in ("article", "main") and not self.dropped[node]:
                up = self.parent[node]
                while up > 0:
                    self.dropped[up] = self.dropped[up] and self.tags[up] in ("aside", "nav", "footer", "head")
                    up = self.parent[up]
        for node in range(1, len(self.tags)):
            self.dropped[node] = self.dropped[node] or self.dropped[self.parent[node]]


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite density, and sum of the children's densities, of every element."""
    n = len(page.tags)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = page.tags[node] == "a" or in_link[page.parent[node]]
    for node, text in page.parts:
        if text and not page.dropped[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for node in range(n - 1, 0, -1):
        if not page.dropped[node]:
            up = page.parent[node]
            chars[up] += chars[node]
            link_chars[up] += link_chars[node]
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (page.tags[node] == "a")
    share = link_chars[0] / max(chars[0], 1)
    density, sums = [0.0] * n, [0.0] * n
    for node in range(n):
        c, lc, t, lt = chars[node], link_chars[node], max(tags[node], 1), max(link_tags[node], 1)
        if c and not page.dropped[node]:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            # The base of the logarithm is e at least, so that pages without links have one too.
            weight = math.log(max(c / max(lc, 1) * t / lt, 1.0)) / max(math.log(base), 1.0)
            density[node] = c / t * weight
            if node:
                sums[page.parent[node]] += density[node]
    return density, sums


def _marked(page: Page) -> list[bool]:
    """Whether an element belongs to the main text."""
    n = len(page.tags)
    density, sums = densities(page)
    best = list(range(n))  # element of largest sum in the subtree, the outer one of equals
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        if not page.dropped[node] and sums[best[node]] > sums[best[up]]:
            best[up] = best[node]
    body = page.tags.index("body") if "body" in page.tags else 0
    target = best[body]
    path = [target]
    while path[-1] not in (body, 0):
        path.append(page.parent[path[-1]])
    named = [k for k in path if page.tags[k] in ("article", "main")]
    marked = [False] * n
    if named:
        marked[named[-1]] = True
    threshold = min(density[k] for k in path)
    for node in range(n):
        # Elements on the path only lead to the target.
        if density[node] >= threshold and density[node] > 0 and node not in path:
            marked[best[node]] = marked[best[node]] or not named or page.tags[node] == "article"
        # Headlines next to the path belong to the article.
        if page.tags[node] in HEADLINES and page.parent[node] in path:
            marked[node] = True
    marked[target] = True
    for node in range(1, n):
        marked[node] = (marked[node] or marked[page.parent[node]]) and not page.dropped[node]
    return marked


def main_text(html: str) -> str:
    """Blocks of the main text, one per line; empty if there is none."""
    page = Page(html)
    marked = _marked(page)
    blocks, block = [], []
    for node, text in page.parts:
        if text is None:
            if block:
                blocks.append(block)
                block = []
        elif marked[node]:
            block.append(text)
    lines = (" ".join("".join(b).split()) for b in [*blocks, block])
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    Args:
        pages: ``page_id``, ``url``, ``html``; other columns are not read.

    Returns:
        page_id, url, text string, n_chars long. One row per input row; null and empty html give
        the empty text, and so does a page that is boilerplate as a whole. Broken markup is read
        as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
