"""Main text of web pages by composite text density.

Every block element and link of a page is a node with its characters, tags, link characters and link tags. A node's
density is its characters per tag, weighed by how few of them are links; the node whose children's densities sum highest
is the article's subtree. (One is added inside the logarithms of the density, which a page without links leaves undefined.) The least density on the path from the body to it is the threshold: other subtrees join the
text where the densities on the way reach it. Before that, elements that are no article by their kind (scripts, menus,
forms, ...) or by their name (adverts, comments, ...) are set aside; a name, and a mark as hidden or a kind of an element
that often wraps a page (form), does not count where its element holds most of the page in several elements of its own.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import slices

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[A-Za-z]+")

_RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_NEVER = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "svg", "canvas", "dialog", "menu", "title", "audio", "video"}
#: Elements that may hold the whole page: their kind and mark as hidden are guarded as names are.
_WRAPS = {"html", "body", "main", "article", "form"}
_HEADINGS = {f"h{i}" for i in range(1, 7)}
#: An open element of the second kind ends where one of the first starts, unless one of the third lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role names of what is no article.
_SET_ASIDE = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "comment comments commentlist disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "related recommended share sharing social footer masthead topbar pagination pager toolbar copyright login search skip contentinfo complementary dialog".split()
)


def _hidden(attributes: str) -> bool:
    """Whether an element is not shown: ``hidden``, ``aria-hidden`` true or the style ``display: none``."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


class Page:
    """The nodes of a page in order of their start tags, and its text as (node, block, text)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.aside, self.named = [-1], ["#root"], [False], [False]
        self.flow: list[tuple[int, int, str]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, at: int, inside: bool) -> int:
        """A new node below ``at``; ``inside`` tells whether an article or main element is open."""
        words = {w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")} if "=" in attributes else set()
        head = (tag == "header" or "header" in words) and not inside
        hidden = bool(attributes) and _hidden(attributes)
        guarded = tag in _WRAPS
        never = tag in _NEVER and not guarded or head and tag == "header" or hidden and not guarded
        named = tag not in ("body", "html", "main", "article") and (bool(words & _SET_ASIDE) or head) or guarded and (hidden or tag in _NEVER)
        self.parent.append(at)
        self.tag.append(tag)
        self.aside.append(never)
        self.named.append(named)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        at, block, upto = 0, 0, 0
        depth: dict[str, int] = {}  # open elements by name
        place, end = 0, len(source)

        def close(to: int) -> None:
            nonlocal at
            while at != to:
                depth[self.tag[at]] -= 1
                at = self.parent[at]

        while True:
            m = _MARKUP.search(source, place)
            start = m.start() if m else end
            if start > upto:
                self.flow.append((at, block, references.unescape(source[upto:start])))
            if not m:
                return
            place = upto = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if m[5] and source[m.end() - 1] != ">":  # the page ends inside a tag
                return
            if tag == "br" or tag in ("img", "wbr"):
                self.flow.append((at, block, " " if tag == "br" else ""))
                continue
            if tag in _INLINE:
                continue
            link = tag == "a"
            if not link and not (closing and not depth.get(tag)):
                block += 1
            if closing:
                if depth.get(tag):
                    to = at
                    while self.tag[to] != tag:
                        to = self.parent[to]
                    close(self.parent[to])
                continue
            if not link and depth.get("p") and tag not in _VOID:
                to = at
                while self.tag[to] not in ("p", "td", "th", "button", "#root"):
                    to = self.parent[to]
                if self.tag[to] == "p":
                    close(self.parent[to])
            ends = _ENDS.get(tag)
            if ends:
                to = at
                while to > 0 and self.tag[to] not in ends[0] and self.tag[to] not in ends[1]:
                    to = self.parent[to]
                if self.tag[to] in ends[0]:
                    close(self.parent[to])
            if tag in _VOID:
                continue
            if tag in _RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, place)
                place = upto = stop.end() if stop else end
                continue
            if attributes.endswith("/") and tag in ("svg", "path", "use"):
                continue
            at = self._open(tag, attributes, at, bool(depth.get("article") or depth.get("main")))
            depth[tag] = depth.get(tag, 0) + 1

    def text(self) -> str:
        """The article's blocks, one to a line."""
        n = len(self.tag)
        own = [0] * n
        for node, _, text in self.flow:
            own[node] += len(text) - text.count(" ") if not text.isspace() else 0

        def summed(skip: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
            chars, tags, link_chars, link_tags = own[:], [0] * n, [0] * n, [0] * n
            for i in range(n - 1, 0, -1):
                if skip[i]:
                    chars[i] = tags[i] = link_chars[i] = link_tags[i] = 0
                    continue
                if self.tag[i] == "a":
                    link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
                p = self.parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i]
            return chars, tags, link_chars, link_tags

        whole = summed([False] * n)
        out = self.aside[:]
        most, inside, _, _ = summed(out)
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]] or self.named[i] and (most[i] <= 0.5 * most[0] or inside[i] < 2)
        chars, tags, link_chars, link_tags = summed(out)
        if not chars[0]:
            return ""
        linked = whole[2][0] / max(whole[0][0], 1)
        density, below = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc = chars[i], link_chars[i]
            if c:
                base = math.log(c / max(c - lc, 1) * lc + linked * c + math.e)
                ratio = max(c / max(lc, 1) * (max(tags[i], 1) / max(link_tags[i], 1)), 1.0)
                density[i] = c / max(tags[i], 1) * math.log(ratio + 1) / math.log(base + 1)
            if i and self.tag[i] != "a":
                below[self.parent[i]] += density[i]
        best = max((i for i in range(n) if chars[i] and not out[i]), key=lambda i: (below[i] or density[i], -i))
        least, i, path = density[best], best, set()
        while i >= 0:
            least = min(least, density[i])
            path.add(i)
            i = self.parent[i]
        content, reached = [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            reached[i] = (i == 0 or reached[p]) and not out[i] and density[i] >= least
            content[i] = not out[i] and (i == best or p >= 0 and content[p] or reached[i] and bool(own[i]))
            if self.tag[i] in _HEADINGS and p in path and self.tag[p] not in ("body", "html", "#root") and not out[i]:
                content[i] = True  # a heading beside the article's subtree
        blocks: list[list[str]] = []
        last = -1
        for node, block, text in self.flow:
            if content[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        lines = (" ".join("".join(x).split()) for x in blocks)
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    """The article of a page; empty for null, empty and textless pages."""
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every row of ``pages``, its ``text`` and ``n_chars`` (code points).

    Null and empty pages, and pages without an article, have an empty text. Repeated rows are kept; other columns are not
    read. Pages may be of any length and depth, cut off or badly nested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_html", 8 << 20):
                texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    some = pages.select(*keep, F.col(html_col).alias("_html"))
    kinds = ", ".join(f"`{c}` {some.schema[c].dataType.simpleString()}" for c in keep)
    return some.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
