"""Main text of web pages by composite text density.

A page becomes a tree of nodes, however broken its markup: elements that HTML closes by itself are closed, stray ends are
passed over, and scanning is linear in the page. Parts that say what they are (menus, forms, scripts, elements whose class, id
or role names a sidebar, an advert, a notice or readers' comments) go first. On the rest each node's density is its characters
a tag, raised or lowered by its share of links; the node whose children's densities have the greatest sum is the article's,
and the least density between it and the body is the threshold: what stands beside the path and is at least as dense belongs
to the article, and lists of links inside that are less dense don't.

Densities are numpy over a page's nodes; pages are spread over tasks, and a page is never in more than one. No shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.llm.common import prepare, tidy

# Names that HTML gives meaning to, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HEAD = frozenset("base link meta noscript script style template title head".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end when one of the same set starts, unless a fence stands between.
SIBLINGS = {**dict.fromkeys(("li",), ("li",)), **dict.fromkeys(("dt", "dd"), ("dt", "dd")), **dict.fromkeys(("td", "th"), ("td", "th")), "tr": ("tr", "td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select", "datalist")}
CELLS = frozenset("table td th caption template html".split())
GONE = frozenset("head script style noscript template iframe object svg math canvas audio video map nav aside footer menu dialog button select textarea input label datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist status".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification popup modal overlay "
    "sidebar rail menu nav navbar navigation topnav breadcrumb breadcrumbs crumbs footer masthead topbar comment comments commentlist disqus reply replies respond discussion share sharing social follow "
    "related recommended recommendations newsletter subscribe subscription signup login search searchbox pager pagination toolbar skip copyright".split()
)
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
CALLS = re.compile(r"(\d+ )?(comments?|replies|responses|kommentare?|commentaires?|comentarios?)( \(?\d+\)?)?:?|leave a (reply|comment)|related( \w+)?|share( this)?( \w+)?|advertisements?|newsletter", re.I)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Page:
    """A page's nodes in page order: ``tags``, ``parents``, ``gone`` (what each says of itself), and ``events``, its texts with their
    nodes; a text of None is a block's edge."""

    def __init__(self, source: str):
        self.tags, self.parents, self.gone, self.named, self.events = ["html"], [-1], [False], [False], []
        self.stack, self.open = [0], {"html": 1}
        self._scan(source)

    def _scan(self, s: str) -> None:
        at, size, unclosed = 0, len(s), {}
        while at < size:
            less = s.find("<", at)
            if less < 0:
                self._text(s[at:])
                return
            if less > at:
                self._text(s[at:less])
            follows = s[less + 1 : less + 2]
            if follows == "!" or follows == "?":
                if s.startswith("<!--", less):
                    end = less + 4 if s.startswith(">", less + 4) else s.find("-->", less + 4)
                    at = size if end < 0 else end + (1 if s[end] == ">" else 3)
                else:
                    at = s.find(">", less) + 1 or size
                continue
            name = _NAME.match(s, less + (2 if follows == "/" else 1))
            if not name:
                if follows == "/":  # </ and no name is a comment
                    at = s.find(">", less) + 1 or size
                else:
                    self._text("<")
                    at = less + 1
                continue
            # The tag's end: a > that no quoted value holds.
            at = name.end()
            while True:
                stop = _STOP.search(s, at)
                if not stop:
                    return
                at, mark = stop.end(), stop[0]
                if mark == ">":
                    break
                if s[name.end() : stop.start()].rstrip()[-1:] == "=" if stop.start() - name.end() < 64 else s[stop.start() - 64 : stop.start()].rstrip()[-1:] == "=":
                    close = -1 if mark in unclosed else s.find(mark, at)
                    if close < 0:
                        unclosed[mark] = True
                    else:
                        at = close + 1
            tag = name[0].lower()
            if follows == "/":
                self._end(tag)
                continue
            self._start(tag, s[name.end() : at - 1])
            if tag in RAW:
                end = _RAW_END[tag].search(s, at)
                at = end.start() if end else size

    def _text(self, text: str) -> None:
        if self.open.get("head") and not text.isspace():
            self._end("head")
        self.events.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def _pop(self, place: int) -> None:
        for node in self.stack[place:]:
            self.open[self.tags[node]] -= 1
            if self.tags[node] in BLOCKS:
                self.events.append((node, None))
        del self.stack[place:]

    def _close(self, tags: tuple[str, ...], fences: frozenset[str] | tuple[str, ...], inline: bool = False) -> None:
        """End the innermost open element of ``tags`` (for several, the outermost of them that no fence parts from here)."""
        if not any(self.open.get(t) for t in tags):
            return
        found = None
        for place in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[place]]
            if tag in tags:
                found = place
                if len(tags) == 1:
                    break
            elif tag in fences or inline and tag in BLOCKS:
                break
        if found is not None:
            self._pop(found)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in HEAD:
            self._end("head")
        if tag in BLOCKS:
            if tag != "br" and self.open.get("p"):
                self._close(("p",), CELLS)
            self.events.append((self.stack[-1], None))
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], FENCES[tag])
        elif tag == "a":
            self._close(("a",), (), True)
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        told = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = {w.lower() for k in ("class", "id") if k in told for w in _WORDS.findall(told[k])}
        gone = tag in GONE or bool(words & HINTS) or told.get("role", "").lower() in ROLES
        unseen = "hidden" in told or told.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(told.get("style", "")) is not None
        self.gone.append("unseen" if unseen else "readers" if words & READERS else gone)
        self.named.append(tag in ("article", "main") or told.get("role", "").lower() in ("main", "article") or told.get("itemprop", "").lower() == "articlebody")
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.events.append((self.stack[-1], None))
            if tag not in ("html", "body"):  # what comes after them is still the body's
                self._close((tag,), CELLS - {tag})
        else:
            self._close((tag,), (), tag != "head")


def _pruned(page: Page) -> np.ndarray:
    """Which nodes go, with all in them, by what they say of themselves. A class like ``no-sidebar`` may stand at what holds the page:
    words don't count, but for those of readers' comments, where half of all text is inside."""
    n = len(page.tags)
    size = [0] * n
    for node, text in page.events:
        size[node] += len(text or "")
    for node in range(n - 1, 0, -1):
        size[page.parents[node]] += size[node]
    holds = list(page.named)  # whether a part that is named as the article is in it
    gone = [False] * n
    chars: dict[int, str] = {}
    for node, text in page.events:
        if text and page.tags[node] in ("h2", "h3", "h4", "h5", "h6") and len(chars.get(node, "")) < 64:
            chars[node] = chars.get(node, "") + text
    calls = {page.parents[node] for node, text in chars.items() if CALLS.fullmatch(" ".join(text.split()))}
    for node in range(n - 1, 0, -1):
        tag, said = page.tags[node], page.gone[node]
        if said is True and tag not in GONE and 2 * size[node] >= size[0]:
            said = False
        inner = holds[node] and not (page.named[node] and tag != "main" and said in (True, "readers"))
        if tag == "main" or tag in ("html", "body"):
            gone[node] = said == "unseen" and tag == "main"
        elif said:
            gone[node] = said == "unseen" or tag in GONE or not inner
        elif tag in ("form", "header"):
            gone[node] = not holds[node]
        elif node in calls:
            gone[node] = not inner and tag in ("div", "section", "ul", "ol", "dl")
        if not gone[node] and holds[node]:
            holds[page.parents[node]] = True
    # A header inside the article keeps its headings.
    inside = [False] * n
    out = np.zeros(n, bool)
    headed = [False] * n
    for node in range(1, n):
        up, tag = page.parents[node], page.tags[node]
        inside[node] = inside[up] or page.named[node]
        headed[node] = headed[up] or (tag == "header" and gone[node] and not page.gone[node] and inside[node])
        if headed[node] and not out[up]:
            title = tag in ("h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "div") and not page.gone[node]
            out[node] = not title and page.tags[up] in ("header", "hgroup", "div")
        else:
            out[node] = out[up] or gone[node]
    return out


def densities(page: Page, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: characters, characters in links, number of links, composite density, and the sum of its children's."""
    n, up = len(page.tags), np.array(page.parents)
    link = np.array([t == "a" for t in page.tags])
    inside = link.copy()
    for node in range(1, n):
        inside[node] |= inside[up[node]]
    chars = np.zeros(n, np.int64)
    for node, text in page.events:
        if text and not gone[node]:
            chars[node] += len(" ".join(text.split()))
    link_chars, tags, links = np.where(inside, chars, 0), (~gone).astype(np.int64), (link & ~gone).astype(np.int64)
    for total in (chars, link_chars, tags, links):
        whole = total.tolist()
        for node in range(n - 1, 0, -1):
            whole[page.parents[node]] += whole[node]
        total[:] = whole
    tags = tags - 1  # those below
    c, lc, t, lt = chars.astype(float), np.maximum(link_chars, 1).astype(float), np.maximum(tags, 1).astype(float), np.maximum(links, 1).astype(float)
    plain = np.maximum(chars - link_chars, 1).astype(float)
    body = max(float(chars[0]), 1.0)
    base = np.log(c / plain * link_chars + link_chars[0] / body * c + np.e)
    with np.errstate(divide="ignore", invalid="ignore"):
        raised = np.log(np.maximum(c / lc * t / lt, 1e-12)) / np.log(np.maximum(base, 1 + 1e-9))
    density = np.where(gone | (chars == 0), 0.0, c / t * np.maximum(raised, 0.0))
    sums = np.zeros(n)
    np.add.at(sums, up[1:], density[1:])
    return chars, link_chars, links, density, np.where(gone, 0.0, sums)


def _chosen(page: Page, gone: np.ndarray) -> np.ndarray:
    """Which nodes' texts are the article's."""
    n, up = len(page.tags), page.parents
    chars, link_chars, links, density, sums = densities(page, gone)
    inline = np.array([t not in BLOCKS for t in page.tags])
    inline[0] = False
    best = int(np.argmax(np.where(inline, -1.0, sums)))
    path = [best]
    while up[path[-1]] >= 0:
        path.append(up[path[-1]])
    low = min(density[node] for node in path)
    live = [node for node in range(n) if page.named[node] and not gone[node] and chars[node]]
    named = next((node for node in path if page.tags[node] == "article"), None) or next((node for node in path if page.named[node]), None)
    if named is None and live:  # the sum is the greatest around an article, not in it
        named_parts = set(live)
        outer = [node for node in live if up[node] not in named_parts]
        if len(outer) == 1 and 4 * chars[outer[0]] >= chars[best]:
            named = outer[0]
    take = np.zeros(n, bool)
    if named is not None:
        take[named] = True
    else:
        take[best] = True
        above, on = set(path[1:]), set(path)
        for node in (node for node in range(1, n) if up[node] in above and node not in on):
            if density[node] >= low > 0 and not inline[node] or page.tags[node] == "h1" and node < best:
                take[node] = True
        titles = [node for node in range(best) if page.tags[node] == "h1" and not gone[node] and chars[node]]
        if titles and not any(page.tags[node] == "h1" for node in range(best, n) if not gone[node]):
            take[titles[-1]] = True
    for node in range(1, n):
        listed = links[node] >= 2 and 2 * link_chars[node] > chars[node] and density[node] < low and page.tags[node] in ("ul", "ol", "div", "section", "dl", "table")
        take[node] = (take[node] or take[up[node]]) and not gone[node] and not listed
    return take


def main_text(source: str | None) -> str:
    """The article of a page as one line: blocks in page order, joined by one space."""
    if not source:
        return ""
    page = Page(source)
    gone = _pruned(page)
    take = _chosen(page, gone).tolist()
    return " ".join("".join(" " if text is None else text if take[node] else "" for node, text in page.events).split())


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each row: the article's text and its code points.

    A null or empty page, and one without a text outside of menus and the like, has an empty text and n_chars 0. Null or repeated
    ids and urls stay as they are, row by row. Pages of any size are read whole. Other columns of ``df``, whatever their names,
    play no part. No rows give no rows.
    """
    prepare(df)
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    chosen = df.select(df[id_col], df[url_col].cast("string").alias(url_col), df[html_col].cast("string").alias("html"))
    return chosen.mapInArrow(tidy(kernel), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
