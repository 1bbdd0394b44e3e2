"""A small, forgiving HTML tree of block elements and runs of text, and the features of its nodes."""

from __future__ import annotations

import html
import math
import re

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*")

# Fixed values of HTML: elements without an end tag, without readable content, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe object canvas audio video select datalist textarea button annotation annotation-xml title".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: An opening tag closes open elements of these names up to a boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

KINDS = ("#text", "p", "h", "li", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "figure", "other")
_KIND = {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "td": "cell", "th": "cell", "tr": "table", "tbody": "table", "thead": "table", "fieldset": "form"} | {f"h{k}": "h" for k in range(1, 7)} | {k: k for k in KINDS}

#: What a word of a class, id or role says about an element.
SIGNS = {
    "content": "article content entry story post text body main prose blog page",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar top logo brand hero",
    "footer": "footer foot copyright legal colophon bottom",
    "sidebar": "sidebar aside side rail widget widgets related recommended recommendations trending popular more tags",
    "notice": "notice cookie cookies consent banner gdpr alert popup modal overlay subscribe newsletter paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion",
    "form": "form search login signin signup register",
    "comments": "comment comments commentlist respond reply replies discussion disqus reader",
    "share": "share sharing social follow byline author meta",
}
_SIGN = {w: k for k, words in enumerate(SIGNS.values()) for w in words.split()}


class Node:
    """An element, or a run of text (tag #text)."""

    __slots__ = ("tag", "parent", "children", "signs", "text", "chars", "linked", "words", "stops", "tags", "blocks", "index", "depth")

    def __init__(self, tag: str, parent: Node | None, signs: tuple = ()) -> None:
        self.tag, self.parent, self.children, self.signs, self.text = tag, parent, [], signs, ""
        self.chars = self.linked = self.words = self.stops = self.tags = self.blocks = 0


def _signs(attributes: str) -> tuple:
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _PART.findall(m[2] or m[3] or m[4] or ""):
            k = _SIGN.get(w.lower())
            if k is not None:
                found.append(k)
    return tuple(found)


def _after_raw(page: str, place: int, tag: str) -> int:
    """Behind the end tag of an element whose content is no markup."""
    end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, place)
    closed = _TOKEN.match(page, end.start()) if end else None
    return closed.end() if closed else len(page)


def _after_dropped(page: str, place: int, tag: str, at: Node) -> tuple[bool, int]:
    """(whether the element ends before what is around it does, behind its end tag or where it was missed)."""
    opened: dict[str, int] = {}
    while m := _TOKEN.search(page, place):
        place, name = m.end(), (m[2] or "").lower()
        if m[1]:
            if name == tag:
                return True, place
            if opened.get(name):
                opened[name] -= 1
                continue
            up = at
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None or name in ("body", "html"):
                return False, m.start()
        elif name in RAW and not m[3].endswith("/"):
            place = _after_raw(page, place, name)
        elif name and name not in VOID and not m[3].endswith("/"):
            opened[name] = opened.get(name, 0) + 1
    return False, len(page)


def parse(page: str) -> list[Node]:
    """All nodes of the page in document order, parents first; the first is the root."""
    root = Node("root", None)
    nodes, at, place, n = [root], root, 0, len(page)
    run: list[str] = []
    linked, link_depth, run_tags, run_linked = 0, 0, 0, 0
    missed: dict[str, int] = {}

    def flush() -> None:
        nonlocal run, run_linked, run_tags
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Node("#text", at)
                leaf.text, leaf.chars, leaf.linked, leaf.tags = text, len(text), min(run_linked, len(text)), run_tags
                leaf.words, leaf.stops, leaf.blocks = text.count(" ") + 1, sum(map(text.count, ".,;:!?")), 1
                at.children.append(leaf)
                nodes.append(leaf)
        run, run_linked, run_tags = [], 0, 0

    while place < n:
        m = _TOKEN.search(page, place)
        begin = m.start() if m else n
        if begin > place:
            text = html.unescape(page[place:begin]) if "&" in page[place:begin] else page[place:begin]
            run.append(text)
            if link_depth:
                run_linked += len(text.strip())
        if not m:
            break
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if closing:
            if tag in INLINE:
                if tag == "a":
                    link_depth = max(0, link_depth - 1)
                continue
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                flush()
                at, link_depth = up.parent, 0
            continue
        if tag in DROPPED:
            flush() if tag not in RAW else None
            if m[3].endswith("/"):
                continue
            if tag in RAW:
                place = _after_raw(page, place, tag)
            elif place > missed.get(tag, 0):
                ends, to = _after_dropped(page, place, tag, at)
                if ends:
                    place = to
                else:
                    missed[tag] = to
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img"):
                run.append(" " if tag != "wbr" else "")
            continue
        if tag in INLINE:
            run_tags += 1
            if tag == "a":
                link_depth += 1
            continue
        flush()
        link_depth = 0
        if tag in ("html", "head", "body"):
            if tag == "body":
                root.signs += _signs(m[3])
            continue
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            up, last = at, None
            while up is not root and up.tag not in stop:
                if up.tag in names:
                    last = up
                up = up.parent
            if last is not None:
                at = last.parent
        elif at.tag == "p" or (at.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag == "p"):
            at = at.parent
        node = Node(tag, at, _signs(m[3]) if m[3] else ())
        at.children.append(node)
        nodes.append(node)
        at = node
    flush()
    return nodes


_STATES = ("article", "nav", "edge", "form")
_STATE = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 2, "aside": 2, "form": 3, "fieldset": 3}
_KIND_AT = {k: i for i, k in enumerate(KINDS)}
#: Features of one node, in order.
FEATURES = [*(f"kind_{k}" for k in KINDS), *(f"sign_{k}" for k in SIGNS), *(f"above_{k}" for k in SIGNS), *(f"in_{k}" for k in _STATES), "depth", "log_chars", "share", "link_density", "tag_density", "stops", "word_length", "blocks", "chars_a_block", "children", "place", "page_place", "sibling_chars", "links_before", "links_after", "parent_links", "parent_share"]


def features(nodes: list[Node]) -> list[list[float]]:
    """A row of FEATURES for each node of one page: its own kind and attribute words, those above it, its subtree's density and its siblings."""
    for k, node in enumerate(nodes):
        node.index = k
        node.depth = node.parent.depth + 1 if node.parent else 0
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.words += node.words
            up.stops += node.stops
            up.blocks += node.blocks
            up.tags += node.tags + (node.tag != "#text")
    total, n = max(1, nodes[0].chars), len(nodes)
    plain = [0.0] * len(SIGNS)
    above, place, rows = [None] * n, [0] * n, []
    for node in nodes:
        for k, child in enumerate(node.children):
            place[child.index] = k
        up = node.parent or node
        over = above[up.index] or [0.0] * (len(SIGNS) + len(_STATES))
        kind = [0.0] * len(KINDS)
        kind[_KIND_AT[_KIND.get(node.tag, "other")]] = 1.0
        signs, below = plain, over
        if node.signs:
            signs = plain.copy()
            for s in node.signs:
                signs[s] = 1.0
        if node.signs or node.tag in _STATE:
            below = over.copy()
            for s in node.signs:
                below[s] = 1.0
            if node.tag in _STATE:
                below[len(SIGNS) + _STATE[node.tag]] = 1.0
        above[node.index] = below
        k, m, chars = place[node.index], len(up.children) if up is not node else 1, max(1, node.chars)
        before = up.children[k - 1] if k else None
        after = up.children[k + 1] if k + 1 < m else None
        rows.append([
            *kind, *signs, *below, node.depth, math.log1p(node.chars), node.chars / total, node.linked / chars, node.tags / chars, node.stops / chars,
            node.chars / max(1, node.words), math.log1p(node.blocks), math.log1p(node.chars / max(1, node.blocks)), math.log1p(len(node.children)), k / max(1, m - 1), node.index / n,
            math.log1p((up.chars - node.chars) / (m - 1)) if m > 1 else 0.0, before.linked / max(1, before.chars) if before else -1.0, after.linked / max(1, after.chars) if after else -1.0,
            up.linked / max(1, up.chars), up.chars / total,
        ])
    return rows


def decode(nodes: list[Node], logits) -> list[bool]:
    """The likeliest choice for all nodes in which nothing is content below what is not.

    best[n] is the gain of calling n content over calling its whole subtree not,
    given the best choices below it.
    """
    gain = [float(v) for v in logits]
    for node in reversed(nodes):
        up = node.parent
        if up is not None and gain[node.index] > 0:
            gain[up.index] += gain[node.index]
    chosen = [False] * len(nodes)
    for node in nodes:
        up = node.parent
        chosen[node.index] = up is None or (chosen[up.index] and gain[node.index] > 0)
    return chosen
