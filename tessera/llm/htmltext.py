"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. A linear classifier over a block's place in the tree and its wording gives each block a cost for
either label, which becomes the capacity of its edge to a terminal; blocks that follow each other or share a parent are joined by
smoothness edges. A maximum flow separates content from boilerplate at the least total cost.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table, typed

#: A tag ends before the next "<" outside quotes, so that no input takes more than linear time.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][^\s/><]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/><]*)([^<>]*)>""", re.S)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup, or not text that a reader sees (fixed values).
RAW = frozenset("script style textarea title noscript template iframe svg select option button audio video canvas noframes xmp datalist annotation annotation-xml".split())
#: Of these, those that end only at their end tag, or else with the page (fixed values).
TO_END = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo mrow mtext mfrac msqrt mroot msup msub msubsup munder mover munderover semantics object".split())
#: A start tag that ends an open element of these kinds (fixed values).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("table ul ol dl div section article main body html nav aside footer header form".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head fieldset legend".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs footer foot colophon header masthead topbar sidebar aside widget widgets comment comments disqus reply replies respond discussion share sharing social follow related recommended recommendations newsletter subscribe subscription signup login register cookie cookies consent gdpr notice notification alert popup modal overlay tooltip pagination pager copyright legal disclaimer search form toolbar skip hidden".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text prose page".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
END_TAGS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: Of these, those that hold others' prose, however much (fixed values).
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())
#: First words of class names that say something about an element's surroundings or subject, not what it is (fixed values).
STATE_WORDS = frozenset("has have with without no not is category cat tag tags topic type format".split())
ADJACENT, SIBLING = 0.5, 0.75
#: What a mark of boilerplate costs, and the share of the page's prose with which an element cannot be boilerplate.
MARK, WRAPPER = 8.0, 0.6


@dataclass(slots=True)
class Block:
    text: str
    place: float  # evidence of the ancestors for content
    mark: _Mark | None  # the innermost ancestor that is marked as boilerplate
    parent: int
    tag: str
    linked: int  # characters inside links
    inside: bool  # below an article or main element


@dataclass(slots=True, eq=False)
class _Mark:
    """An element's marks of boilerplate: how many, by what it is itself (weak) and by what no amount of prose undoes (firm)."""

    up: _Mark | None
    weak: int
    firm: int
    prose: int = 0  # words of prose below
    main: int = 0  # blocks inside an article or main element below
    cost: float = 0.0  # with that of its ancestors


class _Element:
    __slots__ = ("tag", "place", "mark", "inside", "key", "level", "block")

    def __init__(self, tag: str, place: float, mark: _Mark | None, inside: bool, key: int, up: _Element | None = None):
        self.tag, self.place, self.mark, self.inside, self.key = tag, place, mark, inside, key
        self.level = up.level + 1 if up else 0
        self.block = up.block if up and tag in INLINE else self  # the nearest element that is not inline


def _words(value: str) -> set[str]:
    """The words of class names and ids, but not of those names that begin with a word of state, as has-sidebar does."""
    out: set[str] = set()
    for name in value.split():
        parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())
        if len(parts) < 2 or parts[0] not in STATE_WORDS:
            out.update(parts)
    return out


def _place(tag: str, attrs: str, up: _Element) -> tuple[float, int, int, bool]:
    """The evidence for content at an element, its own weak and firm marks of boilerplate, and whether it lies in the main part."""
    place, weak, firm, inside = up.place, 0, 0, up.inside
    if tag in BOILER_TAGS or tag == "header" and not inside:
        weak += 1
    if tag in CONTENT_TAGS:
        place, inside = place + 4, True
    if attrs and not attrs.isspace():
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        names = _words(f"{a.get('class', '')} {a.get('id', '')}")
        if tag not in ("html", "body"):
            if names & BOILER_WORDS and not (tag in CONTENT_TAGS and not names & {"comment", "comments", "reply", "ad", "ads", "related"}):
                weak, firm = (weak, firm + 1) if names & COMMENT_WORDS else (weak + 1, firm)
            elif names & CONTENT_WORDS:
                place += 2
        role = a.get("role", "").lower()
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            firm += 1
        elif role in BOILER_ROLES:
            weak += 1
        elif role in ("main", "article"):
            place, inside = place + 4, True
    return place, weak, firm, inside


def _settle(bs: list[Block], marks: list[_Mark]) -> None:
    """Works out what marks cost. An element with most of the page's prose, and with the whole main part if the page names one, is a
    wrapper around the article: its weak marks cost nothing."""
    prose = main = 0
    for b in bs:
        words = b.text.count(" ") + 1
        n = words if words >= 8 and 2 * b.linked < len(b.text) else 0
        prose, main = prose + n, main + b.inside
        if b.mark:
            b.mark.prose += n
            b.mark.main += b.inside
    for m in reversed(marks):  # an element comes after its ancestors
        if m.up:
            m.up.prose += m.prose
            m.up.main += m.main
    for m in marks:
        wrapper = prose > 0 and m.prose >= WRAPPER * prose and m.main == main
        m.cost = MARK * ((0 if wrapper else m.weak) + m.firm) + (m.up.cost if m.up else 0.0)


def blocks(page: str) -> list[Block]:
    """The blocks of visible text in page order."""
    out: list[Block] = []
    marks: list[_Mark] = []
    stack, opened = [_Element("", 0.0, None, False, 0)], Counter()  # opened: how many of each tag the stack holds
    keys, text, linked, at, breaks = 0, [], 0, 0, 0

    endless: set[str] = set()

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                e = stack[-1].block
                up = stack[max(0, e.level - 1)]
                out.append(Block(whole, stack[-1].place, stack[-1].mark, up.key, e.tag, linked, e.inside))
        text, linked = [], 0

    def cut(i: int) -> None:
        """Closes the elements from place i on."""
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def innermost(tags: set[str], beyond) -> int | None:
        """The place of the innermost open element of these tags, if none that is beyond lies in it."""
        if any(opened[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return i
                if beyond(stack[i].tag):
                    break
        return None

    def close(tag: str) -> None:
        i = innermost({tag}, lambda t: tag in INLINE and t not in INLINE)
        if i is not None:
            if tag not in INLINE:
                flush()
            cut(i)

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        run = page[at : m.start() if m else n]
        if run:
            text.append(run)
            if opened["a"] > 0:
                linked += len(run.strip())
            if not run.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in ("p", "br") or tag not in VOID:
                close(tag)
            continue
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
            continue
        if tag in RAW:
            if not attrs.endswith("/") or tag in TO_END:
                end = None if tag in endless else END_TAGS[tag].search(page, at)
                if not end:
                    endless.add(tag)  # nor will there be one further on
                at = end.end() if end else n if tag in TO_END else at
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if (i := innermost({"p"}, lambda t: t not in INLINE)) is not None:
                cut(i)
            if tag in ENDS and (i := innermost(ENDS[tag], SCOPE.__contains__)) is not None:
                cut(i)
            if tag == "body":
                cut(2 if len(stack) > 1 and stack[1].tag == "html" else 1)
        if attrs.endswith("/"):
            attrs = attrs[:-1]
        keys += 1
        place, weak, firm, inside = _place(tag, attrs, stack[-1])
        mark = stack[-1].mark
        if weak or firm:
            mark = _Mark(mark, weak, firm)
            marks.append(mark)
        stack.append(_Element(tag, place, mark, inside, keys, stack[-1]))
        opened[tag] += 1
    flush()
    _settle(out, marks)
    return out


def evidence(b: Block, any_inside: bool) -> float:
    """The classifier: positive for content. Weights are set by hand; pages carry no labels to learn from."""
    words = b.text.count(" ") + 1
    density = min(1.0, b.linked / max(1, len(b.text)))
    s = b.place - (b.mark.cost if b.mark else 0.0) + min(3.0, 0.15 * words) - 4.0 * density * density
    if b.text[-1:] in ".!?…:;\"'”»)]":
        s += 0.75
    if b.tag in ("h1", "h2", "h3"):
        s += 1.0
    if any_inside and not b.inside:
        s -= 3.0
    if words < 12 and re.match(r"(©|\(c\)|copyright\b|all rights reserved)", b.text, re.I):
        s -= 4.0
    return s


def min_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost of nodes labelled against their sign plus the weights of cut edges, by maximum flow (Dinic).
    cost > 0 is an edge from the source, < 0 one to the sink."""
    n = len(cost)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, forth: float, back: float) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(forth)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, c in enumerate(cost):
        if c > 0:
            add(s, i, c, 0.0)
        elif c < 0:
            add(i, t, -c, 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        while True:  # one blocking flow, without recursion
            path, u = [], s
            while u != t:
                while nxt[u] < len(adj[u]):
                    e = adj[u][nxt[u]]
                    if cap[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    nxt[u] += 1
                if nxt[u] < len(adj[u]):
                    path.append(adj[u][nxt[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    nxt[u] += 1
                else:
                    break
            if u != t:
                break
            f = min(cap[e] for e in path)
            for e in path:
                cap[e] -= f
                cap[e ^ 1] += f


def label(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """As min_cut. A node whose cost exceeds the weights of all its edges keeps its sign in every minimum cut; such nodes are fixed
    first and passed on to their neighbours, so that the flow runs over the doubtful ones only."""
    n, cost = len(cost), list(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, w in edges:
        near[u][v] = near[u].get(v, 0.0) + w
        near[v][u] = near[v].get(u, 0.0) + w
    out: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if out[i] is None and abs(cost[i]) > sum(near[i].values()):
            out[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if out[i] else -w
                del near[j][i]
                todo.append(j)
    rest = [i for i in range(n) if out[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        got = min_cut([cost[i] for i in rest], [(at[i], at[j], w) for i in rest for j, w in near[i].items() if i < j])
        for i, x in zip(rest, got):
            out[i] = x
    return [bool(x) for x in out]


def main_text(page: str | None) -> str:
    """The page's content blocks joined by blank lines; empty for a null or empty page and one without content."""
    bs = blocks(page or "")
    if not bs:
        return ""
    inside = any(b.inside for b in bs)
    edges, last = [(i, i + 1, ADJACENT) for i in range(len(bs) - 1)], {}
    for i, b in enumerate(bs):
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    keep = label([evidence(b, inside) for b in bs], edges)
    return "\n\n".join(b.text for b, k in zip(bs, keep) if k)


@F.pandas_udf(T.StringType())
def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield pd.Series([main_text(p) for p in s], dtype=object)


def op7_min_cut_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page. A null or empty page has the empty text; pages are independent, so repeated rows have equal texts;
    long and deeply nested pages are read whole, in time linear in their length; further columns do not count; an empty table gives no rows."""
    pages = typed(table(spark, sf_dir, "pages"), "page_id long, url string, html string")
    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
