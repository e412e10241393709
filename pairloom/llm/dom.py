"""A small HTML tree: block elements, and a leaf for each run of text between block boundaries."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript template title head iframe object applet canvas svg math audio video map select option optgroup datalist button textarea input meter progress noframes".split())
RAW = frozenset("script style noscript iframe noframes textarea title xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An element of the key ends an open one of the values, up to the nearest of the walls.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str  # "#text" for a leaf
    parent: int
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    linked: int = 0  # letters of a leaf within links
    unseen: bool = False


def _attrs(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)}


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root.

    The places of open elements are kept by tag, so a tag looks at no more of the stack
    than it closes, and a page takes time in proportion to its length.
    """
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones with the block node that they are in
    places: dict[str, list[int]] = {}  # where in the stack each tag is open; "" stands for every block
    parts: list[str] = []
    linked = links = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                node = stack[-1][1]
                nodes.append(Node("#text", node, text=text, linked=linked, unseen=nodes[node].unseen))
            parts.clear()
        linked = 0

    def push(tag: str, node: int) -> None:
        if tag not in INLINE:
            places.setdefault("", []).append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def nearest(tags) -> int:
        """The highest place of an open element of the tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def pop_to(k: int) -> None:
        nonlocal links
        if nearest(("",)) >= k:
            flush()
        for tag, _ in stack[k:]:
            places[tag].pop()
            if tag not in INLINE:
                places[""].pop()
            links -= tag == "a"
        del stack[k:]

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = html.unescape(page[at:stop])
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"])
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            k = nearest(HEADINGS if tag in HEADINGS else (tag,))
            if k and (tag not in INLINE or k > nearest(("",))):
                pop_to(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P:
            k = nearest(("",))
            if stack[k][0] == "p":
                pop_to(k)
        if tag in ENDS:
            wall = nearest(WALLS.get(tag, ("table",)))
            while (k := nearest(ENDS[tag])) > wall:
                pop_to(k)
                if tag in ("li", "dt", "dd", "td", "th", "option"):
                    break
        if tag in INLINE and tag not in UNSEEN:
            if tag not in VOID:
                if tag == "a":
                    links += 1
                push(tag, stack[-1][1])
            continue
        flush()
        attrs = _attrs(m["attrs"] or "")
        parent = stack[-1][1]
        unseen = nodes[parent].unseen or tag in UNSEEN
        if tag not in VOID:
            nodes.append(Node(tag, parent, attrs, unseen=unseen))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "body":  # whatever was open in the head ends here
            nodes[-1].parent, nodes[-1].unseen = 0, False
            links = 0
            del stack[1:]
            places.clear()
            push("body", len(nodes) - 1)
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            push(tag, len(nodes) - 1)
    flush()
    return nodes
