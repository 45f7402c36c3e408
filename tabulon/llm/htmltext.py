"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block is described by
its words and link density, those of its neighbours, and what the elements around it
and their names say; a decision tree, grown from the small labelled table below, says which
blocks belong to the article.

Tags, attributes, comments and raw text are read as the HTML standard has it; where a page leaves
elements open, the next tag that cannot stand inside them ends them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts

#: Elements whose content is characters up to their end tag, and none of the page's text.
RAW = "script style xmp iframe noembed noframes noscript textarea title"
#: Other elements whose content is no text of the page; the first may contain themselves.
NESTING, FLAT = "svg object canvas audio video template", "select option optgroup datalist button map"
#: Elements that part the text around them.
BLOCK = "html head body address article aside blockquote br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
#: Elements that hold no content.
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Elements that the article never is in, those it seldom is in, and those it is in.
OUTER, SELDOM, MAIN = "nav header footer aside menu dialog search", "form fieldset", "article main"
#: Words that name what an element is for: never, seldom, or the article.
OUTER_WORDS = "nav navbar navigation menu masthead footer sidebar ad ads advert advertising advertisement adsense banner sponsor sponsored promo promotion promoted comment comments disqus respond reply replies cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar search skip copyright contentinfo complementary"
SELDOM_WORDS = "header foot side aside rail discussion notice alert more tags meta byline legal disclaimer"
MAIN_WORDS = "article articlebody post entry story content main maintext body text"
#: First and last words of names that tell of a state or a sort, and last words that tell of a place or a part.
STATE_FIRST = "has no is with without hide show js read see view type status format category tag"
STATE_LAST = "open closed off on enabled disabled visible collapsed expanded layout page template theme"
PLACE_LAST = "left right top bottom inner outer wrapper wrap container area section block box list item"
_RAW, _NESTING, _FLAT, _BLOCK, _VOID, _OUTER, _SELDOM, _MAIN, _OUTER_WORDS, _SELDOM_WORDS, _MAIN_WORDS, _STATE_FIRST, _STATE_LAST, _PLACE_LAST = (
    frozenset(x.split()) for x in (RAW, NESTING, FLAT, BLOCK, VOID, OUTER, SELDOM, MAIN, OUTER_WORDS, SELDOM_WORDS, MAIN_WORDS, STATE_FIRST, STATE_LAST, PLACE_LAST)
)
#: A start or end tag; an attribute's quotes only count after its equals sign.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What surroundings and names say of a block: never of the article, seldom, nothing known, of the article.
NEVER, RARELY, NOTHING, HERE = 0, 1, 2, 3
#: What a start tag ends, besides an open paragraph, which any block ends.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}

#: Labelled blocks: words, link density, words and link density of the block before and after,
#: surroundings (2 nothing known, 3 article), heading (0, 1), 1 if part of the article.
TABLE = """
8 0 0 0 60 0 3 1 1 | 5 0 2 1.0 90 0 3 1 1 | 3 0 120 0 40 0 3 0 1 | 1 0 50 0 30 0 3 0 1 | 60 .05 8 0 80 0 3 0 1 | 120 0 60 0 3 0 3 0 1 | 45 .3 70 0 50 0 3 0 1
250 .02 9 0 10 0 3 0 1 | 10 0 12 0 14 0 3 0 1 | 4 0 5 0 6 0 3 0 1 | 2 0 0 0 0 0 3 0 1 | 20 .6 60 .1 90 0 3 0 1 | 6 1.0 80 0 90 0 3 0 1 | 7 0 80 0 4 1.0 3 0 1
5 1.0 6 1.0 7 1.0 3 0 0 | 3 1.0 3 1.0 60 0 3 0 0 | 8 1.0 70 0 9 1.0 3 0 0 | 12 .95 11 1.0 10 1.0 3 0 0 | 4 1.0 4 1.0 4 1.0 3 0 0
3 1.0 2 1.0 4 1.0 2 0 0 | 1 1.0 1 1.0 1 1.0 2 0 0 | 6 1.0 5 1.0 80 0 2 0 0 | 4 0 3 1.0 2 1.0 2 0 0 | 7 .8 6 .9 8 1.0 2 0 0 | 9 0 4 1.0 3 1.0 2 0 0 | 5 .4 2 1.0 6 .9 2 0 0
12 .9 90 0 7 1.0 2 0 0 | 3 0 0 0 2 1.0 2 0 0 | 14 .6 60 0 11 .7 2 0 0 | 25 .7 8 1.0 20 .8 2 0 0 | 2 0 5 1.0 1 0 2 0 0 | 8 0 3 0 4 1.0 2 0 0
40 0 8 0 60 0 2 0 1 | 80 .05 40 0 30 0 2 0 1 | 150 .1 70 0 5 1.0 2 0 1 | 22 0 60 0 90 0 2 0 1 | 6 0 80 0 70 0 2 1 1 | 7 0 2 1.0 90 0 2 1 1 | 12 0 50 0 60 .1 2 0 1
9 .1 45 0 40 0 2 0 1 | 30 .2 45 0 70 0 2 0 1 | 60 0 1 1.0 4 1.0 2 0 1 | 200 0 0 0 0 0 2 0 1 | 5 0 60 0 50 0 2 0 1 | 35 .25 20 0 18 0 2 0 1 | 18 0 40 0 9 0 2 0 1
4 .9 30 0 20 0 2 0 0 | 3 .8 0 0 25 0 2 0 0 | 2 1.0 20 0 3 0 2 0 0 | 10 .85 60 0 40 0 2 0 0 | 6 .7 0 0 40 0 2 0 0 | 5 1.0 50 0 60 0 2 0 0 | 8 .9 0 0 12 0 2 1 0 | 2 0 1 1.0 0 0 2 0 0 | 4 0 2 1.0 0 0 2 0 0 | 3 0 18 0 0 0 2 0 0
2 0 3 .8 25 0 2 1 1 | 3 0 0 0 30 0 2 1 1 | 18 0 25 0 2 1.0 2 0 1 | 20 0 26 0 2 1.0 2 0 1 | 30 0 20 0 1 1.0 2 0 1 | 25 0 2 1.0 30 0 2 0 1 | 26 0 2 0 18 0 2 0 1 | 8 0 30 0 12 0 2 0 1 | 11 0 20 0 15 0 2 0 1
18 0 25 0 2 1.0 3 0 1 | 6 0 30 0 5 1.0 3 0 1 | 3 0 12 0 8 1.0 3 0 1 | 9 0 4 1.0 6 1.0 3 0 1 | 5 0 2 0 4 1.0 3 0 1 | 10 0 0 0 5 1.0 3 0 1 | 40 0 3 1.0 2 1.0 3 0 1 | 14 .3 20 0 9 1.0 3 0 1
10 0 18 1.0 20 1.0 2 0 0 | 14 0 25 .9 22 1.0 2 0 0 | 9 .1 40 .8 30 .9 2 0 0 | 16 0 12 1.0 35 .7 2 0 0 | 11 0 30 .9 14 .9 2 0 0 | 13 .2 22 1.0 45 .8 2 0 0
10 0 18 0 20 0 2 0 1 | 14 0 25 .1 22 0 2 0 1 | 9 .1 40 0 30 .1 2 0 1 | 16 0 12 0 35 0 2 0 1 | 11 0 30 0 14 .1 2 0 1 | 13 .2 22 0 45 0 2 0 1
12 0 20 0 25 .9 2 0 1 | 15 0 30 .9 28 0 2 0 1 | 10 0 60 0 18 1.0 2 0 1 | 12 0 8 1.0 40 0 2 0 1 | 60 0 30 1.0 40 .9 2 0 1 | 45 .1 20 .9 25 1.0 2 0 1 | 80 0 25 1.0 12 1.0 2 0 1
2 0 1 1.0 12 .1 3 1 1 | 4 0 3 1.0 9 0 3 1 1 | 6 0 1 1.0 15 .2 3 1 1 | 3 0 2 1.0 6 0 3 1 1 | 5 0 4 1.0 20 0 3 1 1 | 2 0 1 1.0 12 .1 3 0 1 | 8 0 3 1.0 9 0 3 0 1 | 6 0 1 1.0 15 .2 3 0 1 | 3 0 2 1.0 10 0 3 0 1
3 0 1 1.0 50 0 2 1 1 | 4 0 3 1.0 18 0 2 1 1 | 8 0 2 1.0 12 0 2 1 1 | 3 0 2 1.0 10 0 2 0 0 | 4 0 5 1.0 12 .8 2 0 0 | 3 0 2 1.0 2 1.0 2 1 0 | 2 0 4 1.0 5 .9 2 1 0
"""


@dataclass
class Node:
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: int = 0


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    node = Node(value=int(y.mean() > 0.5) if len(y) else 0)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None)
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            a = x[:, j] <= t
            if min(a.sum(), (~a).sum()) >= least:
                cost = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (a, ~a))
                if cost < best[0]:
                    best = (cost, (j, float(t + np.unique(x[:, j])[np.unique(x[:, j]) > t][0]) / 2, a))
    if best[1]:
        node.feature, node.threshold, a = best[1]
        node.low, node.high = grow(x[a], y[a], depth - 1, least), grow(x[~a], y[~a], depth - 1, least)
    return node


def labelled(table: str = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels. Each of the table's blocks also stands for its like elsewhere:

    where the article never is, it is not; where it seldom is, only long text with few links is.
    """
    rows = np.array([[float(v) for v in r.split()] for line in table.strip().splitlines() for r in line.split("|")])
    never, rarely = rows.copy(), rows.copy()
    never[:, 6], never[:, 8] = NEVER, 0
    rarely[:, 6], rarely[:, 8] = RARELY, (rows[:, 0] >= 15) & (rows[:, 1] <= 0.3)
    rows = np.concatenate((rows, never, rarely))
    return rows[:, :-1], rows[:, -1].astype(int)


def decide(node: Node, row: tuple) -> int:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.threshold else node.high
    return node.value


@lru_cache(100_000)
def _named(token: str) -> int:
    """What one word of a class, id or role hints at. The last part of a compound is what it names."""
    parts = [p.lower() for p in _PART.findall(token)]
    if not parts or parts[0] in _STATE_FIRST and len(parts) > 1 or parts[-1] in _STATE_LAST and len(parts) > 1:
        return NOTHING
    while len(parts) > 1 and parts[-1] in _PLACE_LAST:
        parts.pop()
    last, before = parts[-1], parts[:-1]
    if last in _OUTER_WORDS:
        return NEVER
    if last == "header":  # the site's, or that of an article
        return NOTHING if _MAIN_WORDS.intersection(before) else RARELY if before and before[0] not in ("site", "global", "top") else NEVER
    if last in _SELDOM_WORDS:
        return RARELY
    if last in _MAIN_WORDS:
        return NEVER if _OUTER_WORDS.intersection(before) else HERE
    return NOTHING


def _hint(attributes: str) -> int:
    """What an element's attributes hint at; names of both sorts hint at less."""
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            seen.update(map(_named, html.unescape(value).split()))
        elif name == "hidden" or name == "style" and _HIDDEN.search(value):
            return NEVER
    if HERE in seen:
        return RARELY if NEVER in seen else NOTHING if RARELY in seen else HERE
    return NEVER if NEVER in seen else RARELY if RARELY in seen else NOTHING


class _Ends:
    """Where the tags of one element stand in a page, found once."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def tags(self, name: str) -> tuple[list[int], list[bool]]:
        if name not in self.known:
            found = [(m.start(), m[1] == "/") for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", self.page, re.I)]
            self.known[name] = [x for x, _ in found], [y for _, y in found]
        return self.known[name]

    def after(self, name: str, at: int, raw: bool) -> int | None:
        """Where the end tag of an element stands whose content begins at ``at``; None if it is left open."""
        places, closing = self.tags(name)
        depth = 1
        for i in range(bisect_left(places, at), len(places)):
            if closing[i]:
                depth -= 1
                if not depth:
                    return places[i]
            elif not raw:
                if name not in _NESTING:
                    return None
                depth += 1
        return None


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, surroundings, heading) of all flat blocks with words, in order."""
    out: list[tuple[str, int, float, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    #: Open elements, each with the surroundings outside of it.
    stack: list[tuple[str, int]] = []
    ends = _Ends(page)
    here, heading, link, silent = NOTHING, 0, None, False

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                links = sum(map(str.isalnum, html.unescape("".join(linked)))) if linked else 0
                out.append((text, n, min(1.0, links / max(1, sum(map(str.isalnum, text)))) if links else 0.0, here, heading))
            parts.clear()
            linked.clear()

    def leave(i: int) -> None:
        nonlocal here, link
        here = stack[i][1]
        del stack[i:]
        if link is not None and link > i:  # a link ends with the element it began in
            link = None

    def enter(name: str, attributes: str) -> None:
        nonlocal here
        stack.append((name, here))
        own = _hint(attributes) if attributes and name not in ("html", "body") else NOTHING
        if name in _OUTER and not (name == "header" and here == HERE):
            own = NEVER
        elif name in _SELDOM:
            own = min(own, RARELY)
        elif name in _MAIN:  # also where the article seldom is
            own = HERE if own != NEVER else own
        # What is never of the article stays so, also an article among comments.
        if here != NEVER and own != NOTHING:
            here = own

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if lt > at:
            if not silent:
                parts.append(page[at:lt])
                if link is not None:
                    linked.append(page[at:lt])
            at = lt
            continue
        m = _TAG.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                stop = re.compile(r"-->|--!>|(?<=<!--)-?>").search(page, at + 4)
                at = stop.end() if stop else len(page)
            elif page.startswith("<![CDATA[", at):
                stop = page.find("]]>", at)
                stop = len(page) if stop < 0 else stop
                if not silent:
                    parts.append(page[at + 9 : stop].replace("&", "&amp;"))
                at = stop + 3
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                stop = page.find(">", at)
                at = len(page) if stop < 0 else stop + 1
            elif page[at + 1 : at + 2].isalpha() and page[at + 1 : at + 2].isascii():
                break  # the page ends inside a tag
            else:
                if not silent:
                    parts.append("<")
                at += 1
            continue
        at = m.end()
        closing, name, attributes = m[1] == "/", m[2].lower(), m[3]
        if not closing and (name in _RAW or name in _NESTING or name in _FLAT):
            if attributes.endswith("/"):
                continue
            stop = ends.after(name, at, name in _RAW)
            if name in _FLAT or name in ("iframe", "textarea"):
                close()
            if stop is not None:
                end = page.find(">", stop)
                at = len(page) if end < 0 else end + 1
            elif name in ("script", "style"):
                break  # raw text to the end of the page
            else:
                silent = True  # left open: it ends where something begins that it cannot hold
            continue
        if name not in _BLOCK:
            if closing and (name in _FLAT or name in _NESTING):
                silent = False
            elif name == "a":
                link = None if closing or not re.search(r"(?:^|\s)href", attributes, re.I) else len(stack)
            elif not closing and attributes and name not in _VOID and _hint(attributes) == NEVER:
                close()
                stack.append((name, here))
                here = NEVER
            elif closing and stack and stack[-1][0] == name:
                close()
                leave(len(stack) - 1)
            continue
        close()
        silent = False
        if name in _VOID:
            continue
        if closing:
            heading = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i)
                    break
            continue
        heading = int(name[0] == "h" and name[1:].isdigit())
        while stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        while stack and stack[-1][0] in _ENDS.get(name, ()):
            leave(len(stack) - 1)
            while stack and stack[-1][0] == "p":
                leave(len(stack) - 1)
        if not attributes.endswith("/"):
            enter(name, attributes)
    close()
    return out


def main_text(page: str, tree: Node) -> tuple[str, list[tuple[str, int]]]:
    """(main text, (text, 0 or 1) of all blocks)."""
    found = blocks(page)
    marked = []
    for i, (text, n, density, here, heading) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        marked.append((text, decide(tree, (n, density, *before, *after, here, heading))))
    return " ".join(t for t, y in marked if y), marked


def extract(pages: DataFrame, source: str = "html", key: str = "page_id", url: str | None = "url", with_blocks: bool = False) -> DataFrame:
    """One row per row of ``pages``: ``key, url, text, n_chars`` (and ``blocks``).

    A null, empty or textless page has an empty text. A script, style or comment that is never closed
    takes the rest of the page, as in browsers; other unclosed elements end at the next tag that they cannot hold.
    Repeated rows get equal answers. Other columns are ignored. An empty table gives an empty result.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url") if url else F.lit(None).cast("string").alias("url"), F.col(source).cast("string").alias("text"))
    tree = grow(*labelled())

    def each(raw: list[str | None], batch: pa.RecordBatch) -> dict:
        got = [main_text(t or "", tree) for t in raw]
        out = {"id": batch.column("id"), "url": batch.column("url"), "text": [t for t, _ in got], "n_chars": [len(t) for t, _ in got]}
        if with_blocks:
            out["blocks"] = [[{"text": a, "main": bool(b)} for a, b in y] for _, y in got]
        return out

    def body():
        return each

    # The column to be read is the page; the answer's text replaces it.
    kind = dict(rows.dtypes)["id"]
    return map_texts(rows, "text", body, f"id {kind}, url string, text string, n_chars long" + ", blocks array<struct<text:string,main:boolean>>" * with_blocks).withColumnRenamed("id", key)
