"""Blocks of a page, their costs, and the minimum cut that labels them."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa

_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ATTRS = r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+"
#: Raw elements run to their end tag or the end of the page. An option holds text up to the next option, the end of its
#: list or a block. head has no text of its own: what it hides is raw, and any other text opens the body.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|title|textarea)\b" + _ATTRS + r">(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<option\b" + _ATTRS + r">(?>[^<]+|<(?!/?(?:option|optgroup|datalist|select|" + "|".join(sorted(_BLOCK)) + r")\b))*+"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>" + _ATTRS + r")>|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
#: Elements that are not shown or are no text. Without an end tag only the tag itself goes.
_HIDDEN = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("svg", "noscript", "template", "iframe", "noframes", "select")}
_PARAGRAPH = re.compile(r"<p\b", re.I)
_CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th"}
_SCOPE = frozenset("ul ol menu dl table".split())
_AWAY = frozenset("nav footer aside form button menu dialog fieldset noscript".split())
#: Of these, and of all names, only forms, field sets and noscript may hold a whole article (see wrappers).
_FIRM = frozenset("<nav> <footer> <aside> <button> <menu> <dialog> <header>".split())
_HINT = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Names of what is no article (fixed values, whole words of class names, ids and roles), and names that an article's own
#: parts bear as well.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|byline-share|comments?|commentlist|contentinfo|complementary|consent|cookies?|copyright|crumbs|disclaimer|discussion|disqus|foot|footer|footnav|gdpr|hidden|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notification|overlay|pager|pagination|paging|popup|popular|promo\w*|recommend\w*|related|repl(?:y|ies)|responses?|rss|search|share|sharing|shoutbox|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|topbar|tweet|widget)(?:$|[\s_-])",
    re.I,
)
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:alert|bottom|dialog|head|header|legal|links?|meta|notice|side|tags?|teaser|top|warning)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)
_STOP = re.compile(r"[.!?…。:;,]")

#: Features of a block: its text, its element, the names about it, and name tokens by hash.
NAMED = ("bias", "words", "stops", "dense_stops", "links", "heading", "paragraph", "item", "cell", "good", "bad", "doubtful_outside", "doubtful_inside", "capital")
TOKENS = 64
WIDTH = len(NAMED) + TOKENS
#: The classifier's weights before it has seen a page, and those about which a fit holds them: what names say is kept
#: mostly, what text and elements say is for the pages to show.
PRIOR, START = np.zeros(WIDTH), np.zeros(WIDTH)
PRIOR[: len(NAMED)] = (-1.0, 2.4, 1.2, 0.0, -5.0, 0.8, 0.8, 0.0, 0.0, 4.0, -12.0, -6.0, -2.5, 0.0)
START[: len(NAMED)] = (-0.3, 0.6, 0.3, 0.0, -1.2, 0.2, 0.2, 0.0, 0.0, 2.0, -10.0, -4.0, -1.5, 0.0)
#: Capacities: neighbours on the page by how near they are in the tree (children of one element, of one grandparent,
#: others), and the following child of the same element. Costs count up to LIMIT.
EDGE_SAME, EDGE_NEAR, EDGE_FAR, EDGE_SIBLING, LIMIT = 1.0, 0.6, 0.2, 0.8, 8.0
#: Words of prose that make an article: in an element with a good name, and anywhere else.
PROSE_NAMED, PROSE = 8, 40


def blocks(html: str) -> list[tuple[str, dict, tuple[int, int]]]:
    """(text, features, (parent, grandparent)) of each block with text, in page order."""
    out: list[tuple] = []  # text, linked characters, tag, good, bad, doubtful, tokens, place
    stack: list[tuple[str, int, int, tuple, tuple, frozenset]] = [("", 0, 0, (), ((), ()), frozenset())]  # tag, element, good, bad names, doubtful names outside and inside, tokens
    text: list[str] = []
    linked = in_link = elements = 0
    unclosed: set[str] = set()

    def flush():
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                tag, _, good, bad, doubt, tokens = stack[-1]
                out.append((joined, linked, tag, good, bad, doubt, tokens, (stack[-2][1] if len(stack) > 1 else 0, stack[-3][1] if len(stack) > 2 else 0)))
        text, linked = [], 0

    def add(raw: str):
        nonlocal linked
        piece = unescape(raw) if "&" in raw else raw
        text.append(piece)
        if in_link:
            linked += len(piece.strip())

    def close(tag: str):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                break

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _HIDDEN:
            if not m["end"] and not m["attr"].endswith("/") and tag not in unclosed:
                if stop := _HIDDEN[tag].search(html, at):
                    if tag == "noscript" and _PARAGRAPH.search(html, at, stop.start()):
                        flush()
                        _, _, good, bad, doubt, tokens = stack[-1]
                        elements += 1
                        stack.append((tag, elements, good, (*bad, "<noscript>"), doubt, tokens))
                    else:
                        at = stop.end()
                else:
                    unclosed.add(tag)
            elif m["end"] and tag == "noscript" and any(x[0] == tag for x in stack):
                flush()
                close(tag)
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCK:
            flush()
            if m["end"]:
                close(tag)
                continue
            while len(stack) > 1 and stack[-1][0] == "p":
                stack.pop()
            if closes := _CLOSES.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes.split():
                        del stack[k:]
                        break
                    if stack[k][0] in _SCOPE:
                        break
            if tag == "hr":
                continue
            _, _, good, bad, doubt, tokens = stack[-1]
            hints = " ".join(h.strip("\"'") for h in _HINT.findall(m["attr"])) if m["attr"] else ""
            named = bool(hints) and tag not in ("body", "html")
            hint_bad = named and tag not in ("article", "main") and bool(_BAD.search(hints))
            hint_doubt = named and tag not in ("article", "main") and bool(_DOUBTFUL.search(hints))
            # a good name beside the bad one, as in "post tag-news", leaves the block to its text and the cut
            torn = (hint_bad or hint_doubt) and any(_GOOD.search(h) and not _BAD.search(h) and not _DOUBTFUL.search(h) for h in hints.split())
            if tag in _AWAY or hint_bad and not torn:
                bad = (*bad, f"<{tag}>" if tag in _AWAY else hints)
            elif tag == "header" or hint_doubt and not torn:
                name = "<header>" if tag == "header" else hints
                doubt = (doubt[0], (*doubt[1], name)) if good else ((*doubt[0], name), doubt[1])
            if tag in ("article", "main") or named and not torn and _GOOD.search(hints):
                good += 1
            if named:
                tokens = tokens | {len(NAMED) + zlib.crc32(h.lower().encode("utf-8", "surrogatepass")) % TOKENS for h in hints.split()}
            elements += 1
            stack.append((tag, elements, good, bad, doubt, tokens))
    if at < len(html):
        add(html[at:])
    flush()
    idle = wrappers(out)
    return [(t, features(t, linked, tag, good, set(bad) - idle, (set(doubt[0]) - idle, doubt[1]), tokens), place) for t, linked, tag, good, bad, doubt, tokens, place in out]


def wrappers(found: list[tuple]) -> set[str]:
    """Names that say nothing on this page. A name tells boilerplate from an article only where the page has an article
    without it: prose (PROSE words in sentences that are not mostly links, or PROSE_NAMED in an element with a good name). Where there is
    none, the names about most of the prose, if it is PROSE words, are those of the article's own wrappers, as
    <form id="aspnetForm"> or <div class="popular-science"> about all of a page. Of equal ones the first on the page."""
    named = free = 0
    under: dict[tuple, int] = {}
    for text, linked, _, good, bad, doubt, _, _ in found:
        words = text.count(" ") + 1
        if 2 * linked >= len(text) or not _STOP.search(text):
            continue
        names = bad + doubt[0]
        if names:
            if not _FIRM.intersection(names):
                under[names] = under.get(names, 0) + words
        elif good and not doubt[1]:
            named += words
        else:
            free += words
    if named >= PROSE_NAMED or named + free >= PROSE or not under:
        return set()
    most = max(under, key=under.get)
    return set(most) if under[most] >= PROSE else set()


def features(text: str, linked: int, tag: str, good: int, bad: set, doubt: tuple, tokens: frozenset) -> dict[int, float]:
    words = text.count(" ") + 1
    stops = len(_STOP.findall(text))
    named = (
        1.0, min(words, 40) / 40, float(stops > 0), min(1.0, stops / words), linked / len(text), float(tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(tag in ("p", "blockquote", "pre")),
        float(tag in ("li", "dt", "dd")), float(tag in ("td", "th")), float(good > 0), float(bool(bad)), float(bool(doubt[0])), float(bool(doubt[1])), float(text[:1].isupper()),
    )
    return {i: v for i, v in enumerate(named) if v} | dict.fromkeys(tokens, 1.0)


def costs(found: list, weights) -> list[float]:
    """Log-odds that each block is content."""
    w = weights.tolist()
    return [max(-LIMIT, min(LIMIT, sum(w[i] * v for i, v in f.items()))) for _, f, _ in found]


def edges(places: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(i, j, capacity): neighbours on the page, and each block with the one before it under the same element."""
    out, last = [], {}
    for i, (parent, grand) in enumerate(places):
        if i:
            p, g = places[i - 1]
            out.append((i - 1, i, EDGE_SAME if p == parent else EDGE_NEAR if g == grand or g == parent or p == grand else EDGE_FAR))
        j = last.get(parent)
        if j is not None:
            out.append((j, i, EDGE_SIBLING))
        last[parent] = i
    return out


def minimum_cut(w: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks lie on the source's side of a minimum cut. Block i hangs on the source with capacity w[i], or on the sink
    with -w[i]. A block whose terminal outweighs all its edges is decided, and its edges become its neighbours' terminals;
    what is left goes to the maximum flow."""
    n, w = len(w), list(w)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    room = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(w[i]) >= room[i]:
            side[i] = w[i] > 0
            for j, c in near[i].items():
                if side[j] is None:
                    w[j] += c if side[i] else -c
                    room[j] -= c
                    del near[j][i]
                    todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        number = {i: k for k, i in enumerate(left)}
        reached = max_flow([w[i] for i in left], [(number[i], number[j], c) for i in left for j, c in near[i].items() if i < j])
        for i in left:
            side[i] = reached[number[i]]
    return side


def max_flow(w: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes that the source still reaches when a maximum flow is found, by blocking flows along shortest paths."""
    n = len(w)
    supply, demand = [max(x, 0.0) for x in w], [max(-x, 0.0) for x in w]
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for i, j, c in links:
        head[i].append(len(to)), head[j].append(len(to) + 1)
        to += [j, i]
        cap += [c, c]
    while True:
        level = [0 if s > 1e-9 else -1 for s in supply]
        order = [i for i in range(n) if level[i] == 0]
        goal = None
        for u in order:
            if goal is not None and level[u] >= goal:
                break
            if demand[u] > 1e-9:
                goal = level[u]
                continue
            for e in head[u]:
                v = to[e]
                if cap[e] > 1e-9 and level[v] < 0:
                    level[v] = level[u] + 1
                    order.append(v)
        if not any(demand[u] > 1e-9 and level[u] >= 0 for u in range(n)):
            return [x >= 0 for x in level]
        next_edge = [0] * n
        for s in range(n):
            while supply[s] > 1e-9 and level[s] == 0:
                path, u = [], s
                while demand[u] <= 1e-9:
                    while next_edge[u] < len(head[u]):
                        e = head[u][next_edge[u]]
                        if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                            break
                        next_edge[u] += 1
                    else:
                        if not path:
                            break
                        level[u] = -1
                        u = to[path.pop() ^ 1]
                        next_edge[u] += 1
                        continue
                    path.append(e)
                    u = to[e]
                if demand[u] <= 1e-9:
                    break
                flow = min(supply[s], demand[u], *(cap[e] for e in path)) if path else min(supply[s], demand[u])
                supply[s] -= flow
                demand[u] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def labelled(found: list, weights) -> list[bool]:
    return minimum_cut(costs(found, weights), edges([b[2] for b in found]))


def fit(pages: list[list], *, rounds: int = 2, steps: int = 150, tie: float = 0.002) -> np.ndarray:
    """Weights by self-training on pages' blocks. First the blocks on whose place all names agree are labelled (in an article and
    under no other name, or under bad ones alone); then all of them, by the cut under the weights so far. Each time a logistic
    regression is fitted, with a Gaussian prior about START (both labels weigh the same). Without blocks of both labels
    the weights are those of PRIOR."""
    flat = [b for p in pages for b in p]
    if not flat:
        return PRIOR
    x = np.zeros((len(flat), WIDTH))
    for i, (_, f, _) in enumerate(flat):
        x[i, list(f)] = list(f.values())
    good, bad, outside, inside = (x[:, NAMED.index(n)] > 0 for n in ("good", "bad", "doubtful_outside", "doubtful_inside"))
    y = np.where(good & ~bad & ~outside & ~inside, 1.0, np.where(bad & ~good | outside & ~good, 0.0, np.nan))
    weights = PRIOR
    for k in range(rounds):
        if k:
            y = np.array([float(s) for p in pages for s in labelled(p, weights)])
        known = ~np.isnan(y)
        if not (y[known] == 1).any() or not (y[known] == 0).any():
            return weights
        a, t = x[known], y[known]
        share = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
        w, m, v = START.copy(), np.zeros(WIDTH), np.zeros(WIDTH)
        for step in range(1, steps + 1):
            g = a.T @ ((1 / (1 + np.exp(-np.clip(a @ w, -30, 30))) - t) * share) + tie * (w - START)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = w
    return weights


def main_text(html: str | None, weights=PRIOR) -> str:
    found = blocks(html or "")
    return "\n\n".join(b[0] for b, keep in zip(found, labelled(found, weights)) if keep)


def sampler(page_blocks: int):
    """mapInArrow: key, html -> key, the page's blocks without their text, pickled; none of pages with more blocks."""

    def run(batches):
        for batch in batches:
            found = [blocks(h.as_py() or "") for h in batch.column(1)]
            rows = [pickle.dumps([("", f, place) for _, f, place in page] if len(page) <= page_blocks else []) for page in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["key", "blocks"])

    return run


def extractor(model):
    """mapInArrow: page_id, url, html -> page_id, url, text, n_chars."""

    def run(batches):
        weights = model.value
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run
