"""Main text of web pages by minimum cut.

A page becomes a row of text blocks.  A linear classifier of each block (kind of element
and class names it stands in, link density, length, punctuation) gives the cost of
calling it content or boilerplate: the capacities to the two terminals.  Neighbours in
page order and blocks of one parent are joined by smoothness edges, the weaker the
further apart in the tree.  The minimum cut labels all blocks of a page at once.  Blocks
whose own cost outweighs all their edges are settled beforehand, which changes no minimum
cut, so the flow runs only over blocks that are in doubt.

Defined results: NULL, empty and text-free pages give the empty text; unclosed and stray
tags are tolerated; scripts, styles, comments and the title are never text; the head ends
where something begins that cannot stand in it; an unclosed title or textarea goes up to the
next tag, and an unclosed script, style or template up to the body or the end; nothing is
cut or capped; equal rows each give a row.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from muster.llm.common import named

# Elements by how they are laid out and what they are for.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strong sub sup time tt u var".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
AWAY = frozenset(
    "nav footer aside form button select option dialog menu iframe object svg canvas audio "
    "video map noframes datalist fieldset".split()
)
HOME = frozenset(["article", "main"])
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination "
    "pager footer masthead comment comments commentlist disqus reply replies respond feedback "
    "related recommended recommendations share sharing social widget login search toolbar "
    "skip copyright disclaimer contentinfo complementary".split()
)
HOME_NAMES = frozenset("article main content post entry story".split())
# What these words lead says how a page is laid out, not what the element is.
STATES = frozenset("has no with without not is hide show".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[/a-zA-Z!?][^>]*>",
    re.S | re.I,
)
# Elements whose inside is no markup, by what may end them: their own end tag first.
RAW = {
    tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|(?P<stop>{stop})", re.I)
    for tag, stop in [
        *[(tag, r"\Z") for tag in ("script", "style", "template")],
        *[(tag, rf"<{tag}\b|<body\b|</head\b|\Z") for tag in ("title", "textarea", "noscript")],
    ]
}
BODY = re.compile(r"<body\b", re.I)
ATTRIBUTES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME = re.compile(r"[a-z]+")

# The classifier: log-odds of content.
BASE = -1.5
IN_HOME = 6.0
IN_AWAY = -30.0
# A name of boilerplate takes the place of IN_HOME; long text and neighbours can outweigh it.
NAMED = -5.0
PER_LOG_WORD = 0.6
PER_MARK = 0.5
MOST_MARKS = 4
LINKS = -4.0
HEADING = 0.5
# Smoothness between blocks next to each other, and between those of one parent.
ADJACENT = 1.2
SIBLING = 0.6


class _Block:
    __slots__ = ("text", "links", "away", "home", "named", "heading", "parent", "depth")

    def __init__(self, text, links, away, home, named, heading, parent, depth):
        self.text, self.links, self.away, self.home, self.named = text, links, away, home, named
        self.heading, self.parent, self.depth = heading, parent, depth


def _names_away(token: str, home: bool) -> bool:
    """Whether a class or id, as a whole or by its first or last part, names boilerplate."""
    parts = NAME.findall(token)
    if not parts or parts[0] in STATES:
        return False
    ends = {parts[0], parts[-1]}
    return bool(ends & AWAY_NAMES) or ("header" in ends and not home)


def _standing(
    tag: str, attributes: str, away: bool, home: bool
) -> tuple[bool, bool, bool]:
    """Whether an element of this kind, in one that stands so, is away or at home, and
    whether it has a name of boilerplate.

    An id of a heading, or of a section at home, says what its text is about.
    """
    if tag in ("html", "body"):
        return away, home, False
    if tag in AWAY or (tag == "header" and not home):
        return True, home, False
    named = False
    if attributes:
        if HIDDEN.search(attributes):
            return True, home, False
        names = set()
        topic = (len(tag) == 2 and tag[0] == "h") or (tag == "section" and home)
        for kind, value in ATTRIBUTES.findall(attributes):
            kind, value = kind.lower(), value.strip("\"'").lower()
            if kind == "role" and not AWAY_NAMES.isdisjoint(value.split()):
                return True, home, False
            if kind == "id" and topic:
                continue
            names.update(NAME.findall(value))
            named = named or any(_names_away(token, home) for token in value.split())
        if names & HOME_NAMES and tag not in INLINE and not named:
            home = True
    return away, home or tag in HOME, named


def _after_raw(html: str, tag: str, begin: int) -> int:
    """Where the page goes on after a raw element whose start tag ends at ``begin``."""
    end = RAW[tag].search(html, begin)
    if end["stop"] is None:
        return end.end()
    if tag in ("script", "style", "template"):
        body = BODY.search(html, begin)
        return body.start() if body else len(html)
    if tag == "noscript":
        return begin
    following = html.find("<", begin)
    return len(html) if following < 0 else following


def blocks_of(html: str) -> list[_Block]:
    """The text blocks of a page in order."""
    out: list[_Block] = []
    # Open elements: tag, away, home, number, depth, numbers of the named ones around it.
    stack = [("", False, False, 0, 0, ())]
    # Elements that hold the page's main part or an article: their names count for nothing.
    holders: set[int] = set()
    numbered = 0
    parts: list[str] = []
    in_links = 0
    link_open = 0

    def flush() -> None:
        nonlocal in_links
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                at = len(stack) - 1
                while at and stack[at][0] in INLINE:
                    at -= 1
                tag, _, _, number, depth, _ = stack[at]
                _, away, home, _, _, named = stack[-1]
                parent = stack[at - 1][3] if at else 0
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                out.append(_Block(text, in_links / len(raw), away, home, named, heading, parent, depth))
            parts.clear()
        in_links = 0

    def text(piece: str) -> None:
        nonlocal in_links
        parts.append(piece)
        if link_open:
            in_links += len(piece)

    def close(at: int) -> None:
        nonlocal link_open
        link_open -= sum(e[0] == "a" for e in stack[at:])
        del stack[at:]

    last = 0
    while m := TAG.search(html, last):
        begin = m.start()
        if begin > last:
            text(html[last:begin])
        last = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1]:
                last = _after_raw(html, tag, last)
            continue
        if tag == "head":  # what may stand in it is never text, and all else ends it
            flush()
            continue
        if m[1]:
            at = len(stack) - 1
            while at and stack[at][0] != tag:
                at -= 1
            if tag not in INLINE:
                flush()
            if at:
                if tag in INLINE and any(e[0] not in INLINE for e in stack[at:]):
                    flush()
                close(at)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                at = len(stack) - 1
                while at and stack[at][0] in INLINE:
                    at -= 1
                if at and stack[at][0] == "p":
                    close(at)
            elif tag in SAME:
                at = len(stack) - 1
                while at and (stack[at][0] in INLINE or stack[at][0] == "p"):
                    at -= 1
                if at and stack[at][0] in SAME[tag]:
                    close(at)
        if m[3].endswith("/") and tag not in INLINE:
            continue
        _, away, home, _, depth, around = stack[-1]
        away_, home_, named = _standing(tag, m[3], away, home)
        if tag in INLINE and (named or away_ != away):
            flush()
        numbered += 1
        if tag in HOME:
            holders.update(around)
        stack.append((tag, away_, home_, numbered, depth + 1, (*around, numbered) if named else around))
        if tag == "a":
            link_open += 1
    if last < len(html):
        text(html[last:])
    flush()
    for block in out:
        block.named = not holders.issuperset(block.named)
    return out


def cost(block: _Block) -> float:
    """Log-odds that a block is content."""
    words = block.text.count(" ") + 1
    marks = block.text.count(". ") + block.text.count(",") + block.text.endswith((".", "!", "?"))
    return (
        BASE
        + IN_HOME * (block.home and not block.named)
        + IN_AWAY * block.away
        + NAMED * block.named
        + PER_LOG_WORD * words.bit_length()
        + PER_MARK * min(MOST_MARKS, marks)
        + LINKS * block.links
        + HEADING * block.heading
    )


def edges_of(blocks: list[_Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and neighbours under one parent."""
    out = []
    latest: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            apart = abs(a.depth - b.depth) + (0 if a.parent == b.parent else 2)
            out.append((i - 1, i, ADJACENT / (1 + apart)))
        before = latest.get(b.parent)
        if before is not None:
            out.append((before, i, SIBLING))
        latest[b.parent] = i
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least total cost: for i labelled False max(costs[i], 0), for True
    max(-costs[i], 0), and an edge's weight where its ends differ."""
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # what outweighs its edges is settled, and becomes a cost of its neighbours
        i = todo.popleft()
        if label[i] is None and abs(costs[i]) >= sum(near[i].values()):
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                costs[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    doubt = [i for i in range(n) if label[i] is None]
    if doubt:
        content = _source_side(costs, near, doubt)
        for i in doubt:
            label[i] = i in content
    return label


def _source_side(costs: list[float], near: list[dict[int, float]], nodes: list[int]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by blocking flows along levels."""
    tiny = 1e-9
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        flow[i] = dict(near[i])
    for i in nodes:
        if costs[i] > 0:
            flow[source][i], flow[i][source] = costs[i], 0.0
        elif costs[i] < 0:
            flow[i][sink], flow[sink][i] = -costs[i], 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, room in flow[a].items():
                if room > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return set(level)
        # What is left to try from each node: dropped once it is full or leads nowhere.
        ahead = {a: [b for b in flow[a] if level.get(b) == level[a] + 1] for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = list(zip(path, path[1:]))
                least = min(flow[x][y] for x, y in steps)
                for x, y in steps:
                    flow[x][y] -= least
                    flow[y][x] += least
                cut = next(k for k, (x, y) in enumerate(steps) if flow[x][y] <= tiny)
                del path[cut + 1 :]
                continue
            while ahead[a] and flow[a][ahead[a][-1]] <= tiny:
                ahead[a].pop()
            if ahead[a]:
                path.append(ahead[a][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by one space."""
    blocks = blocks_of(html or "")
    labels = minimum_cut([cost(b) for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select(
        named(id_col).alias("page_id"), named(url_col).alias("url"), named(html_col).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
