"""Main text of web pages by composite text density.

A page becomes a DOM of plain arrays in one pass over its tags (unclosed and implied end tags are closed as
browsers do). Each node's density is its characters per tag, adjusted for the share of them in links. Sums of
the children's densities are compared below the body: the lowest density on the path from the node with the
largest sum up to the body is the threshold, and of the nodes that reach it the one with the largest sum holds
the article. Where the path from it to the body leads through an article or main element, which reaches the
threshold too, that element is its edge.

Before anything is counted, parts that are no text of the article by their element (menus, forms, scripts) or
by a whole word of their class, id or role (``comments``, ``site-footer``, not ``has-sidebar``) are set apart;
never one that holds the article or main element, and, where a page has neither, never one that by its class
alone would take most of the text along.

Time is linear in the page: every character is scanned a bounded number of times, and end tags look their
element up instead of walking the open ones.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes that can set a part apart.
MARKED = re.compile(r"class|id|role|hidden|style", re.I)
#: Elements whose content is raw text and never shown as text of the page.
RAW = {"script", "style", "textarea", "iframe", "title", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold no article text.
APART = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "head", "noscript", "template", "svg", "object", "canvas", "select"} | RAW
#: Of these, the ones that may wrap a whole page.
WRAPPERS = {"header", "aside", "form", "dialog"}
BLOCKS = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark menus, adverts, notices and comments.
BOILERPLATE = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice pagination popup promo promotion related respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets alert complementary contentinfo search".split()
)
#: Words that may stand beside them in one name ("site-footer", "comments-area").
BESIDE = set(
    "site main page global top bottom left right primary secondary upper lower sub bar box area list block section wrap wrapper container inner outer slot unit panel "
    "text message links icons buttons form policy gdpr posts articles thread item body holder region col row mobile desktop fixed sticky the".split()
)
#: End tags that a start tag implies.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "td", "th", "blockquote", "main"}
CLOSES_P = BLOCKS - {"br", "p"}
#: End tags that close nothing outside the list, table or section that is open.
KEPT_IN_SCOPE = {"b", "i", "em", "strong", "span", "a", "u", "small", "font", "p", "li"}


def names_boilerplate(name: str) -> bool:
    """Whether one class, id or role names boilerplate as a whole, alone or beside words of place."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    return not BOILERPLATE.isdisjoint(words) and all(w in BOILERPLATE or w in BESIDE for w in words)


@functools.lru_cache(maxsize=20_000)
def marked_apart(attributes: str) -> str:
    """``hidden`` if the attributes hide an element, ``named`` if a name marks it as boilerplate, else empty."""
    named = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "hidden"
        if key in ("class", "id", "role") and not named:
            named = any(map(names_boilerplate, value.split()))
    return "named" if named else ""


class Dom:
    """Nodes in page order: parent, tag, own pieces of text (block number, text), and whether it is apart or a link."""

    def __init__(self, html: str):
        self.parent, self.tag, self.link = [-1], ["#root"], [False]
        self.mark = [""]  # why a node would be set apart: "element", "hidden", "named"
        self.pieces: list[tuple[int, int, str]] = []
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # depths of the open elements of each tag
        self.scopes: list[int] = []  # depths of the open elements that bound implied end tags
        self.read(html)
        self.set_apart()

    def read(self, html: str) -> None:
        block = at = text_from = 0
        last_end, quotes = html.rfind(">"), True

        def text(upto: int) -> None:
            if upto > text_from:
                self.pieces.append((self.stack[-1], block, html[text_from:upto]))

        while (at := html.find("<", at)) >= 0:
            after = html[at + 1 : at + 2]
            if html.startswith("<!--", at):
                text(at)
                end = html.find("-->", at + 4)
                at = text_from = end + 3 if end >= 0 else len(html)
                continue
            closing = after == "/"
            name = NAME.match(html, at + 2 if closing else at + 1) if closing or after.isalpha() else None
            if (name is None and after not in ("!", "?")) or at > last_end:
                at += 1  # a sign, not a tag
                continue
            text(at)
            if name is None:
                at = text_from = html.find(">", at) + 1
                continue
            tag = name[0].lower()
            end, quotes = tag_end(html, name.end(), quotes)
            attributes = html[name.end() : end]
            at = text_from = end + 1
            if tag in BLOCKS:
                block += 1
            if closing:
                self.end(tag)
                continue
            if tag in BLOCKS:
                self.close(CLOSES.get(tag, ()))
                if tag in CLOSES_P:
                    self.close(("p",))
            if tag in VOID:
                continue
            self.start(tag, attributes)
            if tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = html.find(">", found.end() - 1) + 1 if found else 0
                at = text_from = at or len(html)
                self.end(tag)
            elif attributes.rstrip().endswith("/"):
                self.end(tag)
        if text_from < len(html):
            text(len(html))

    def start(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        self.parent.append(up)
        self.tag.append(tag)
        self.link.append(self.link[up] or tag == "a")
        mark = "element" if tag in APART else ""
        if not mark and tag not in ("html", "body") and attributes and MARKED.search(attributes):
            mark = marked_apart(attributes)
        self.mark.append(mark)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(len(self.parent) - 1)

    def cut(self, depth: int) -> None:
        """End the open elements from ``depth`` on."""
        for node in reversed(self.stack[depth:]):
            self.open[self.tag[node]].pop()
            if self.tag[node] in SCOPES:
                self.scopes.pop()
        del self.stack[depth:]

    def end(self, tag: str) -> None:
        depths = self.open.get(tag)
        if depths and (tag not in KEPT_IN_SCOPE or not self.scopes or depths[-1] > self.scopes[-1]):
            self.cut(depths[-1])

    def close(self, tags) -> None:
        """End the nearest open element of ``tags``, but none outside the list, table or section that is open."""
        depth = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if depth and (not self.scopes or depth >= self.scopes[-1]):
            self.cut(depth)

    def set_apart(self) -> None:
        """Decide which marked nodes are apart, with all that is below them."""
        n = len(self.parent)
        size, paragraphs, whole = [0] * n, [False] * n, [False] * n
        for node, _, text in self.pieces:
            size[node] += len(text.strip())
        sure = [False] * n  # apart whatever it holds
        for i in range(1, n):
            m = self.mark[i]
            sure[i] = sure[self.parent[i]] or m == "hidden" or (m == "element" and self.tag[i] not in WRAPPERS)
        for i in range(n - 1, 0, -1):  # text below each node, and whether it holds an article or main element
            p = self.parent[i]
            if sure[i]:
                continue
            size[p] += size[i]
            paragraphs[p] |= paragraphs[i] or self.tag[i] == "p"
            whole[p] |= whole[i] or (self.tag[i] in ("article", "main") and not self.mark[i] and size[i] > 0)
        total, articles = size[0], whole[0]
        self.apart = [False] * n
        for i in range(1, n):
            apart = self.apart[self.parent[i]] or sure[i]
            if not apart and self.mark[i] and not whole[i]:
                most = not articles and 2 * size[i] > total and (self.mark[i] == "named" or (self.tag[i] == "form" and paragraphs[i]))
                apart = not most
            self.apart[i] = apart
        self.pieces = [x for x in self.pieces if not self.apart[x[0]]]


def tag_end(html: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Place of the ``>`` that ends a tag, and whether quotes still count.

    A quote counts after an equals sign. Where counting them leaves a tag without an end, they no longer count in the
    rest of the page, so that a page of stray quotes is read once.
    """
    if quotes:
        i = at
        while m := STOP.search(html, i):
            i = m.end()
            if m[0] == ">":
                return m.start(), True
            if html[max(at, m.start() - 8) : m.start()].rstrip().endswith("="):
                i = html.find(m[0], i) + 1
                if not i:
                    break
    return html.find(">", at), False


def main_node(dom: Dom) -> int:
    n = len(dom.parent)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in dom.pieces:
        size = len(text.strip())
        chars[node] += size
        links[node] += size * dom.link[node]
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if not dom.apart[i]:
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (dom.tag[i] == "a")
    whole = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    if not chars[whole] or 2 * chars[whole] < chars[0]:
        whole = 0
    share = links[whole] / chars[whole] if chars[whole] else 0.0

    def density(i: int) -> float:
        c, t = chars[i], max(1, tags[i])
        if not c or dom.apart[i]:
            return 0.0
        linked, plain = links[i], max(1, c - links[i])
        base = math.log(c / plain * linked + share * c + math.e)
        return c / t * math.log(max(1.0, c * t / (max(1, linked) * max(1, link_tags[i]))) + 1e-9 + 1, base) if base > 1 else c / t

    own = [density(i) for i in range(n)]
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        sums[dom.parent[i]] += own[i]
    inside = [i for i in range(n) if chars[i] and not dom.apart[i]]
    if not inside:
        return whole
    top = max(inside, key=lambda i: (sums[i], -i))
    # The threshold is the lowest density on the path from the node with the largest sum up to the body.
    threshold, i = own[top], top
    while i > 0:
        threshold = min(threshold, own[i])
        if i == whole:
            break
        i = dom.parent[i]
    best = max((i for i in inside if own[i] >= threshold), key=lambda i: (sums[i], -i), default=top)
    # An article or main element on the path reaches the threshold as well: it is the subtree's natural edge.
    i = best
    while i > 0 and i != whole:
        if dom.tag[i] in ("article", "main"):
            return i
        i = dom.parent[i]
    return best


def extract(html: str | None) -> str:
    """The article's blocks, one a line; empty for a null or empty page."""
    if not html:
        return ""
    dom = Dom(html)
    top = main_node(dom)
    below = [False] * len(dom.parent)
    below[top] = True
    for i in range(top + 1, len(dom.parent)):
        below[i] = below[dom.parent[i]]
    lines, last = [], None
    for node, block, text in dom.pieces:
        if below[node]:
            if block == last:
                lines[-1].append(text)
            else:
                lines.append([text])
                last = block
    joined = (" ".join(unescape("".join(x)).split()) for x in lines)
    return "\n".join(x for x in joined if x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``url_col``, text, n_chars (its code points).

    A null or empty page has an empty text; null ids and repeated rows stay as they are; an empty table gives an
    empty result; further columns are left out. ``<br>`` ends a block, as the edge of a paragraph does: what follows it is on a line of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [extract(h) for h in b["html"]]
            yield b[["id", "url", "text"]].astype({"id": "Int64"})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(run, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
