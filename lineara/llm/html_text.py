"""Main text of web pages by line-block distribution.

Method. Markup is stripped into lines, one for each block element. Lines in elements that are never text (scripts, forms, navigation,
footers, asides and the like, by tag or role) are left out. A line weighs the length of its text outside links; inside a marked
article it weighs its whole length. The weights are summed over sliding windows of ``WINDOW`` lines. A surge is where a sum rises to
``SURGE`` times the highest one, a dive where it falls below that again; the lines between a surge and its dive are a candidate. The
heaviest candidate decides: the article is the innermost container that holds most of it, or the marked article around that
container. All text of the article is kept; candidates outside it are kept if they weigh ``SHARE`` of the heaviest one and
no article is marked. So marks only help to find the borders: a marked article with hardly any text loses to the real text.

A form around the page, as some servers write it, and an article inside an article are suspects too. A form goes unless it holds
most of the text. Inner articles are reader comments and go, unless the text of the outer one outside them is less than ``SHARE`` of theirs:
then they are its stories.

Class and id words never decide alone. A word that names boilerplate (``sidebar``, ``post-comments``) makes its element a suspect; words
that tell a state (``has-sidebar``, ``share-enabled``) don't. A suspect is boilerplate unless it holds most of the article's text.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do where that is simple (an
unfinished tag ends the page); character references are decoded once; no length is cut. Input columns beyond page_id, url
and html are ignored; repeated rows give repeated results. The time is linear in the page, however deep the markup is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window.
WINDOW = 3
#: Share of the highest window's sum at which the text surges and dives.
SURGE = 0.2
#: Without a marked article, another candidate is kept if it has this share of the heaviest candidate's text.
SHARE = 0.2

# Element names of HTML.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
    th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    """head script style noscript template nav footer aside button select textarea iframe object svg math canvas audio
    video dialog menu title xmp noembed noframes map""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies
    consent gdpr notice notices notification alert disclaimer newsletter subscribe subscription signup popup modal overlay nav navbar
    navigation menu breadcrumb breadcrumbs masthead topbar toolbar sidebar sidebars widget widgets related recommended share sharing
    social footer foot copyright comment comments commentlist disqus respond reply replies discussion pagination pager skip""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words of a compound that tell a state and not what the element is.
STATE = frozenset("has no not is with without show hide open closed enabled disabled on off allowed active visible hidden ready layout".split())
HOLDS = frozenset("article aside blockquote body center dd details div dl fieldset figure html li main menu ol section table tbody td tr ul".split())
LISTS = frozenset("dl menu ol table ul".split())
_BARS_P = frozenset("td th li div section article blockquote table".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = ("ul", "ol", "dl", "table", "select", "menu")
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_SPACE = re.compile(r"\s+")


def suspect(attrs: str) -> str:
    """What class and id words say of an element: "" nothing, "weak" a compound, "strong" the word itself, "comments"."""
    found = ""
    for token in attrs.split():
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if x]
        hits = [x for x in parts if x in WORDS]
        if not hits or (len(parts) > 1 and not STATE.isdisjoint(parts)):
            continue
        if not COMMENTS.isdisjoint(hits):
            return "comments"
        if parts[-1] in WORDS:
            found = "strong"
        found = found or "weak"
    return found


class Page:
    """The lines of a page and the containers around them.

    ``lines`` has (text, characters inside links, container); a container is a number, ``up`` gives the one around it, ``end`` the
    number after the last one inside it. ``suspects`` and ``marks`` are containers with what was said of them.
    """

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, int]] = []
        self.up, self.tag, self.end = [-1], [""], [0]
        self.suspects: dict[int, str] = {}
        self.marks: dict[int, str] = {}
        self._read(html)

    def _open(self, up: int, tag: str) -> int:
        self.up.append(up)
        self.tag.append(tag)
        self.end.append(0)
        return len(self.up) - 1

    def _read(self, html: str) -> None:
        parts: list[str] = []
        linked = links = 0
        stack: list[tuple[str, int]] = []  # tag and the container that it is in or opens
        places: dict[str, list[int]] = defaultdict(list)  # depths of every open tag
        blocks: list[int] = []  # depths of open block elements
        bars: list[int] = []  # depths of open elements that a paragraph outside them survives
        articles = 0
        dead = 0  # depth at which weightless content began, 0 for none
        at, n, naive = 0, len(html), False

        def end_line() -> None:
            nonlocal parts, linked
            if parts and not dead:
                text = _SPACE.sub(" ", unescape("".join(parts))).strip()
                if text:
                    self.lines.append((text, linked, stack[-1][1] if stack else 0))
            parts, linked = [], 0

        def pop_to(depth: int) -> None:
            nonlocal dead, articles, links
            while len(stack) > depth:
                name, node = stack.pop()
                here = len(stack)
                if places[name] and places[name][-1] == here:
                    places[name].pop()
                for held in (blocks, bars):
                    if held and held[-1] == here:
                        held.pop()
                links -= name == "a"
                articles -= name == "article"
                if node != (stack[-1][1] if stack else 0):
                    self.end[node] = len(self.up)
                if dead > here:
                    dead = 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not dead:
                parts.append(text)
                if links > 0:
                    linked += len(text)

        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                add(html[at:])
                break
            add(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = n if end < 0 else end + 3
                continue
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = None if naive else _TAG.match(html, lt)
            if m:
                closing, tag, attrs, at = bool(m[1]), m[2].lower(), m[3], m.end()
            elif not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and html[lt + 2 : lt + 3].isalpha()):
                add("<")
                at = lt + 1
                continue
            else:
                naive = True  # a quote is never closed: from here a tag ends at the next >
                end = html.find(">", lt)
                if end < 0:
                    break
                named = re.match(r"(/?)([^\s/>]*)(.*)", html[lt + 1 : end], re.S)
                closing, tag, attrs, at = bool(named[1]), named[2].lower(), named[3], end + 1
            if tag == "br":
                add(" ")
                continue
            block = tag in BLOCKS
            if block:
                end_line()
            if closing:
                if places[tag]:
                    depth = places[tag][-1]
                    # an inline end tag doesn't close blocks around it
                    if block or tag in NEVER or not (blocks and blocks[-1] > depth):
                        pop_to(depth)
                    else:
                        places[tag].pop()
                        links -= tag == "a"
                        stack[depth] = ("", stack[depth][1])
                continue
            if tag in _CLOSES_P and places["p"] and not (bars and bars[-1] > places["p"][-1]):
                pop_to(places["p"][-1])
            elif tag in _SAME:
                depth = max((places[x][-1] for x in _SAME[tag] if places[x]), default=-1)
                if depth > max((places[x][-1] for x in _STOPS if places[x]), default=-1):
                    pop_to(depth)
            if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
                continue
            node = stack[-1][1] if stack else 0
            said = ""
            if not dead:
                said, mark = _described(tag, attrs, articles > 0)
                if said == "dead":
                    dead = len(stack) + 1
                elif said or mark or tag in HOLDS:
                    node = self._open(node, tag)
                    if said:
                        self.suspects[node] = said
                    if mark:
                        self.marks[node] = mark
            places[tag].append(len(stack))
            if block:
                blocks.append(len(stack))
            if tag in _BARS_P:
                bars.append(len(stack))
            stack.append((tag, node))
            links += tag == "a"
            articles += tag == "article"
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                if not end:
                    break
                add(html[at : end.start()])
                at = end.start()
        end_line()
        pop_to(0)
        self.end[0] = len(self.up)


def _described(tag: str, attrs: str, in_article: bool) -> tuple[str, str]:
    """Whether an element is "dead", or what suspicion there is, and which mark of an article it bears."""
    inner = tag == "article" and in_article
    mark = tag if tag in ("article", "main") and not inner else ""
    by_tag = "inner" if inner else "weak" if tag == "form" else ""
    if tag in NEVER or (tag == "header" and not in_article):
        return "dead", ""
    if not attrs or "=" not in attrs:
        return ("dead" if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attrs) else by_tag), mark
    if tag in ("html", "body"):
        return "", ""
    named = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    role = named.get("role", "").lower()
    if role in ROLES or named.get("aria-hidden", "").lower() == "true" or "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower():
        return "dead", ""
    if role == "main" or named.get("itemprop") == "articleBody":
        mark = mark or "main"
    said = f"{named.get('class', '')} {named.get('id', '')}"
    found = suspect(said)
    if not found and not in_article and tag in ("div", "section", "td") and "header" in said.lower().split():
        found = "strong"
    return (found if by_tag != "inner" or found == "comments" else by_tag) or by_tag, mark


def distribution(weights: np.ndarray, window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Surge and dive of every candidate, as a half-open range of lines."""
    if not len(weights) or not weights.max():
        return []
    # The sum at i covers the window's lines up to i; before the first and after the last line there is nothing.
    sums = np.convolve(weights, np.ones(window, dtype=np.int64), "full")
    high = np.concatenate([[0], (sums >= max(1, surge * sums.max())).astype(np.int8), [0]])
    up, down = np.flatnonzero(np.diff(high) == 1), np.flatnonzero(np.diff(high) == -1)
    return [(int(a), int(max(a + 1, min(b - window + 1, len(weights))))) for a, b in zip(up, down, strict=True) if a < len(weights)]


def _spread(page: Page, own: np.ndarray) -> np.ndarray:
    """Sums over each container and all those inside it."""
    total = own.copy()
    for k in range(len(total) - 1, 0, -1):
        total[page.up[k]] += total[k]
    return total


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    page = Page(html or "")
    n = len(page.up)
    if not page.lines:
        return ""
    texts, linked, node = zip(*page.lines, strict=True)
    node, size = np.array(node), np.array([len(t) for t in texts])
    free = np.maximum(size - np.array(linked), 0)
    inside = np.zeros(n, bool)  # in a marked article
    for k in range(1, n):
        inside[k] = inside[page.up[k]] or k in page.marks
    mass = _spread(page, np.bincount(node, free, n))
    marked = _spread(page, np.bincount(node, size * inside[node], n))

    # For each article, what the articles directly inside it hold.
    total = _spread(page, np.bincount(node, size, n))
    host, inner = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(1, n):
        host[k] = host[page.up[k]]
        if page.suspects.get(k) == "inner":
            inner[host[k]] += total[k]
        if page.suspects.get(k) == "inner" or page.marks.get(k) == "article":
            host[k] = k

    gone = np.zeros(n, bool)
    for k in range(1, n):
        said = page.suspects.get(k)
        if said == "inner":
            around = host[page.up[k]]
            said = "" if total[around] - inner[around] < SHARE * inner[around] else said
        elif said and marked[0]:
            around = not inside[k] or (said == "weak")  # around the article, or a vaguely named part of it
            said = "" if said != "comments" and around and 2 * marked[k] > marked[0] else said
        elif said == "weak" and 2 * mass[k] > mass[0]:
            said = ""
        gone[k] = gone[page.up[k]] or bool(said)
    live = np.flatnonzero(~gone[node])
    node, size, free = node[live], size[live], free[live]
    weights = np.where(inside[node], size, free)
    found = distribution(weights, window, surge)
    if not found:
        return ""
    a, b = max(found, key=lambda r: weights[r[0] : r[1]].sum())
    heaviest = weights[a:b].sum()
    held = _spread(page, np.bincount(node[a:b], weights[a:b], n))
    home = int(np.flatnonzero(2 * held > heaviest)[-1])
    article = around = home
    while around > 0:  # the marked article around it: an <article>, else the outermost other mark
        if page.marks.get(around) == "article":
            article = around
            break
        article = around if around in page.marks else article
        around = page.up[around]
    own = (node >= article) & (node < page.end[article])
    if page.marks.get(article):
        keep = own
    else:
        # Links in lists are no part of an unmarked article, unless the list stands between two lines of candidates in the container of
        # one of them; nor is what has no text of its own before or after it, but for a linked paragraph of some length right before
        # the first line.
        listed = np.zeros(n, bool)
        around_list = np.full(n, -1)  # the container around the outermost list
        for k in range(article + 1, page.end[article]):
            up = page.up[k]
            listed[k] = listed[up] or page.tag[k] in LISTS
            around_list[k] = around_list[up] if listed[up] else up if listed[k] else -1
        keep, dense = own & (free > 0), np.zeros(len(node), bool)
        for c, d in found:
            if weights[c:d].sum() >= SHARE * heaviest:
                keep[c:d] |= weights[c:d] > 0
                dense[c:d] |= weights[c:d] > 0
        at, i = np.flatnonzero(keep), np.arange(len(keep))
        between = (i > at[0]) & (i < at[-1])
        before, after = (at[np.clip(np.searchsorted(at, i) + step, 0, len(at) - 1)] for step in (-1, 0))
        beside = listed[node] & ((around_list[node] == node[before]) | (around_list[node] == node[after]))
        within = between & beside & dense[before] & dense[after]
        first = at[0]
        if first > 0 and own[first - 1] and node[first - 1] == node[first] and size[first - 1] >= SHARE * size[at].mean():
            keep[first - 1] = True
        keep |= own & between & ~listed[node] | own & within
    return "\n".join(texts[live[i]] for i in np.flatnonzero(keep))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_SCHEMA)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page. One pass, no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
