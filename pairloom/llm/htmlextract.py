"""Main text of web pages by a tree-structured graphical model.

Each node of the page's tree is content or not. A node has evidence (its tag, the
parts of its class, id and role; a text run its length, links and punctuation), and
each parent and child have a potential that depends on what the child is. Messages go
up from the leaves and down from the root once (sum-product), which gives each run of
text its exact marginal; runs that are more likely content than not are the main text.

The potentials are smoothed counts over labelled pages. The labelled pages are made
here, by a seeded generator of page layouts whose parts are known; their number is a
parameter. The trained model is a few hundred numbers and goes with the task.

Defined results: a null or empty page has empty text; a page without any element is
one run of text; unclosed, crossed and cut-off tags are repaired as browsers do in the
common cases; repeated rows are each extracted; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.dom import Node, parse

PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _bucket(n: int) -> int:
    return min(n.bit_length(), 8)


def features(node: Node, nodes: list[Node]) -> list[str]:
    if node.tag == "#text":
        words, n = node.text.count(" ") + 1, len(node.text)
        ends = node.text[-1] in ".!?。！？…\"'”’)"
        stops = sum(node.text.count(c) for c in ",.;:")
        return [f"w{_bucket(words)}{ends:d}", f"l{min(4, 4 * node.linked // n)}", f"s{min(3, 20 * stops // words)}"]
    out = []
    named = " ".join(node.attrs.get(a, "") for a in ("class", "id", "role", "itemprop", "aria-label"))
    out += [f".{p.lower()}" for p in dict.fromkeys(PART.findall(named))]
    if "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in node.attrs.get("style", "").replace(" ", ""):
        out.append("hidden")
    return out


def _keys(node: Node, nodes: list[Node]) -> tuple[str, str, str]:
    """The kinds of a child whose potential holds, the most special first."""
    return f"{node.tag} in {nodes[node.parent].tag}", node.tag, "text" if node.tag == "#text" else "element"


class TreeModel:
    """Evidence as log ratios by feature, and potentials [parent][child] by the child's kind."""

    def __init__(self, evidence: dict[str, float], edges: dict[str, tuple[float, float, float, float]]):
        self.evidence, self.edges = evidence, edges

    @classmethod
    def train(cls, pages: list[tuple[list[Node], list[bool]]], smooth: float = 0.5, strongest: float = 6.0, rare: int = 20, edge_smooth: float = 0.01) -> TreeModel:
        """Counts to potentials; a part of what is no content is taken to be none where no page says otherwise."""
        seen = {False: defaultdict(float), True: defaultdict(float)}
        total = {False: defaultdict(float), True: defaultdict(float)}
        pairs: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
        for nodes, labels in pages:
            for node, y in zip(nodes[1:], labels[1:]):
                if node.unseen:
                    continue
                found = features(node, nodes)
                total[y]["#text" if node.tag == "#text" else "element"] += bool(found)
                for f in found:
                    seen[y][f] += 1
                for key in _keys(node, nodes):
                    pairs[key][2 * labels[node.parent] + y] += 1
        evidence = {}
        for f in seen[False].keys() | seen[True].keys():
            kind = "element" if f[0] in ".h" else "#text"
            p = [math.log((seen[y][f] + smooth) / (total[y][kind] + 2 * smooth)) for y in (False, True)]
            most = strongest if kind == "element" else 0.15 * strongest  # runs of one list or table say much the same
            evidence[f] = max(-most, min(most, p[1] - p[0]))
        edges = {}
        for key, n in pairs.items():
            if " in " in key and sum(n) < rare:
                continue
            off, on = n[0] + n[1] + 1 + edge_smooth, n[2] + n[3] + 2 * edge_smooth
            edges[key] = ((n[0] + 1) / off, (n[1] + edge_smooth) / off, (n[2] + edge_smooth) / on, (n[3] + edge_smooth) / on)
        return cls(evidence, edges)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Of each node, the probability that it is content."""
        n = len(nodes)
        own0, own1 = [1.0] * n, [1.0] * n
        own0[0] = 1e-3  # a page has content
        get = self.evidence.get
        for i in range(1, n):
            r = 0.0
            for f in features(nodes[i], nodes):
                r += get(f, 0.0)
            r = max(-30.0, min(30.0, r))
            own0[i], own1[i] = 1 / (1 + math.exp(r)), 1 / (1 + math.exp(-r))
        edges = self.edges
        edge = [(1.0, 0.0, 0.0, 1.0)] * n
        up0, up1 = own0[:], own1[:]  # evidence of a node with all that is below it
        msg: list[tuple[float, float]] = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            node = nodes[i]
            e = edge[i] = next((edges[k] for k in _keys(node, nodes) if k in edges), (0.9, 0.1, 0.5, 0.5))
            a, b = up0[i], up1[i]
            to0, to1 = e[0] * a + e[1] * b, e[2] * a + e[3] * b
            s = to0 + to1
            msg[i] = to0, to1 = to0 / s, to1 / s
            p = node.parent
            x, y = up0[p] * to0, up1[p] * to1
            s = x + y or 1.0
            up0[p], up1[p] = x / s, y / s
        down: list[tuple[float, float]] = [(0.5, 0.5)] * n
        out = [0.5] * n
        out[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, n):
            p = nodes[i].parent
            # belief of the parent without what came from this child
            a, b = down[p][0] * up0[p] / max(msg[i][0], 1e-300), down[p][1] * up1[p] / max(msg[i][1], 1e-300)
            e = edge[i]
            x, y = a * e[0] + b * e[2], a * e[1] + b * e[3]
            s = x + y or 1.0
            down[i] = x / s, y / s
            x, y = down[i][0] * up0[i], down[i][1] * up1[i]
            out[i] = y / (x + y or 1.0)
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        if all(x.tag == "#text" for x in nodes[1:]):
            return " ".join(x.text for x in nodes[1:])
        p = self.marginals(nodes)
        return " ".join(x.text for x, y in zip(nodes, p) if x.tag == "#text" and not x.unseen and y > 0.5)


class PageMaker:
    """Labelled pages: layouts of parts whose role is known; an element that is content has data-y="1"."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = [a + b for a in ("", "b", "st", "r", "k", "m", "th", "v", "é", "ш", "n") for b in ("a", "en", "io", "or", "u", "ée", "ing", "да")]
        self.vocabulary = ["".join(self.r.choices(syllables, k=self.r.randint(1, 4))) for _ in range(3000)]

    def words(self, a: int, b: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(a, b)))

    def sentence(self, a: int = 3, b: int = 18) -> str:
        w = self.r.choices(self.vocabulary, k=self.r.randint(a, b))
        return (" ".join(x + ("," if self.r.random() < 0.1 else "") for x in w)).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def maybe(self, p: float) -> bool:
        return self.r.random() < p

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(a, b)}</a>'

    def el(self, tag: str, inside: str, name: str = "", y: int = 0) -> str:
        attr = f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attr} data-y="{y}">{inside}</{tag}>'

    def name(self, *kinds: str) -> str:
        k = self.r.choice(kinds)
        return self.r.choice([k, k, f"{k}-{self.r.choice(['box', 'wrap', 'area', 'main', 'inner', 'top', '1', 'block', 'list'])}", f"{self.r.choice(['site', 'page', 'js', 'c', 'post', 'widget'])}-{k}", f"{k} {self.r.choice(['clearfix', 'row', 'col', 'wide', 'active'])}"])

    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(3, 9)))
        return self.r.choice([lambda: self.el("nav", f"<ul>{items}</ul>", self.r.choice(["", self.name("nav", "menu", "navigation", "navbar")])), lambda: self.el("div", f"<ul>{items}</ul>", self.name("nav", "menu", "navigation", "navbar", "topbar", "breadcrumb", "breadcrumbs")), lambda: self.el("ul", items, self.name("menu", "nav", "links", "tabs", "pagination", "pager"))])()

    def advert(self) -> str:
        inside = self.r.choice([self.sentence, lambda: f"<p>{self.sentence()}</p>", lambda: f"{self.link(2, 6)}", lambda: f"<p>{self.sentence()} {self.sentence()}</p>{self.link()}", lambda: f"{self.sentence()} {self.sentence()} {self.sentence()}"])()
        return self.el(self.r.choice(["div", "div", "div", "aside", "section"]), inside, self.name("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner", "adsense"))

    def notice(self) -> str:
        body = f"<p>{self.sentence()} {self.sentence()}</p>" if self.maybe(0.6) else self.sentence()
        return self.el("div", body + self.r.choice(["", f"<button>{self.words(1, 2)}</button>", self.link()]), self.name("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "privacy", "warning", "message", "paywall", "disclaimer", "announcement"))

    def form(self) -> str:
        inside = self.r.choice([f"<label>{self.words(1, 3)}</label><input name=q>", f"<p>{self.sentence()}</p><input type=email><button>{self.words(1, 2)}</button>", f"<legend>{self.words(1, 3)}</legend><p>{self.sentence()}</p><textarea>{self.words(0, 4)}</textarea>"])
        f = self.el("form", inside, self.r.choice(["", self.name("search", "login", "contact", "subscribe", "signup")]))
        return self.el("div", f"<h3>{self.words(1, 4)}</h3>{f}", self.name("newsletter", "subscribe", "signup", "login", "search")) if self.maybe(0.4) else f

    def comments(self) -> str:
        one = lambda: self.el(self.r.choice(["div", "li", "article"]), f'{self.r.choice([f"<b>{self.words(1, 2)}</b>", self.el("div", self.words(1, 3), "author"), ""])}<p>{" ".join(self.sentence() for _ in range(self.r.randint(1, 5)))}</p>', self.name("comment", "reply", "response"))
        inside = "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.el(self.r.choice(["div", "section", "ol", "aside"]), f"<h{self.r.randint(2, 4)}>{self.words(1, 3)}</h2>{inside}{self.form() if self.maybe(0.4) else ''}", self.name("comments", "comment", "discussion", "responses", "disqus", "replies", "respond"))

    def sidebar(self) -> str:
        parts = [self.menu, self.advert, lambda: f"<h3>{self.words(1, 3)}</h3><p>{self.sentence()}</p>", self.related, self.form, lambda: f"<p>{self.sentence()} {self.sentence()}</p>"]
        inside = "".join(self.r.choice(parts)() for _ in range(self.r.randint(1, 4)))
        tag = self.r.choice(["aside", "aside", "div", "div", "section"])
        return self.el(tag, inside, "" if tag == "aside" and self.maybe(0.5) else self.name("sidebar", "sidebar", "side", "aside", "rail", "secondary", "widgets", "complementary"))

    def related(self) -> str:
        items = "".join(f"<li>{self.link(2, 7)}</li>" for _ in range(self.r.randint(2, 6)))
        return self.el(self.r.choice(["div", "section", "aside"]), f"<h3>{self.words(1, 3)}</h3><ul>{items}</ul>", self.name("related", "recommended", "popular", "more", "trending", "latest", "share", "social", "sharing", "tags", "recirculation"))

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.words(1, 4)}</h1><p>{self.sentence(2, 8)}</p>", f"<div>{self.link()}</div>", f"<p>{self.words(1, 4)}</p>", self.words(1, 6)]) + (self.menu() if self.maybe(0.5) else "") + (self.form() if self.maybe(0.2) else "")
        tag = self.r.choice(["header", "header", "div"])
        return self.el(tag, inside, "" if tag == "header" and self.maybe(0.6) else self.name("header", "masthead", "top", "branding", "logo", "banner", "hero"))

    def footer(self) -> str:
        inside = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>&copy; {self.words(1, 4)}. {self.sentence()}</p>", f"<p>{self.sentence()}</p><p>{self.link()} | {self.link()}</p>", self.words(3, 12)]) + (self.menu() if self.maybe(0.3) else "")
        tag = self.r.choice(["footer", "footer", "div"])
        return self.el(tag, inside, "" if tag == "footer" and self.maybe(0.6) else self.name("footer", "foot", "copyright", "legal", "bottom", "credits", "contentinfo", "colophon"))

    def paragraph(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 1, 2, 3, 4, 6, 9])))
        w = text.split(" ")
        for _ in range(self.r.choice([0, 0, 1, 2])):
            k = self.r.randrange(len(w))
            w[k] = self.r.choice([f'<a href="/x">{w[k]}</a>', f"<b>{w[k]}</b>", f"<em>{w[k]}</em>", f"{w[k]}<br>", f"<code>{w[k]}</code>"])
        return " ".join(w)

    def article(self) -> str:
        out = [f'<h1 data-y="1">{self.sentence(2, 10)}</h1>'] if self.maybe(0.85) else []
        if out and self.maybe(0.1):
            out = [self.el("header", out[0] + (f'<p data-y="1">{self.words(2, 6)}</p>' if self.maybe(0.5) else ""), self.r.choice(["", "entry-header"]), 1)]
        for _ in range(self.r.choice([1, 2, 3, 4, 6, 9, 14])):
            k = self.r.random()
            if k < 0.76:
                p = self.paragraph()
                out.append(self.r.choice([f'<p data-y="1">{p}</p>', f'<p data-y="1">{p}', f'<p data-y="1"><b>{p}<br>', f'<div data-y="1">{p}</div>' if self.maybe(0.3) else f'<p data-y="1">{p}</p>']))
            elif k < 0.82:
                out.append(f'<h{self.r.choice("234")} data-y="1">{self.words(1, 7)}</h2>')
            elif k < 0.87:
                items = "".join(f'<li data-y="1">{self.sentence() if self.maybe(0.6) else self.words(1, 6)}</li>' for _ in range(self.r.randint(2, 6)))
                tag = self.r.choice(["ul", "ol"])
                out.append(f'<{tag} data-y="1">{items}</{tag}>')
            elif k < 0.9:
                out.append(f'<blockquote data-y="1"><p data-y="1">{self.paragraph()}</p></blockquote>' if self.maybe(0.5) else f'<blockquote data-y="1">{self.paragraph()}</blockquote>')
            elif k < 0.92:
                out.append(f'<pre data-y="1">{self.words(3, 20)}</pre>')
            elif k < 0.95:
                rows = "".join(f'<tr data-y="1"><td data-y="1">{self.words(1, 4)}<td data-y="1">{self.words(1, 4)}</tr>' for _ in range(self.r.randint(1, 4)))
                out.append(f'<table data-y="1"><tbody data-y="1">{rows}</tbody></table>')
            elif k < 0.96:
                out.append(f'<figure data-y="1"><img src=x.png><figcaption data-y="1">{self.sentence()}</figcaption></figure>')
            else:
                out.append(self.r.choice([self.advert, self.related, self.form, self.notice, self.sidebar])())
        body = "".join(out)
        if self.maybe(0.3):
            body = self.el(self.r.choice(["div", "section"]), body, self.r.choice(["", self.name("content", "entry", "body", "text")]), 1)
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        named = "" if tag in ("article", "main") and self.maybe(0.6) else self.name("content", "post", "entry", "article", "story", "text", "body", "main", "single", "hentry")
        tail = "".join(x() for x, p in ((self.related, 0.1), (self.comments, 0.1), (self.footer, 0.03)) if self.maybe(p))
        return self.el(tag, body + tail, named, 1)

    def page(self) -> str:
        middle = [self.article()]
        for part, p in ((self.sidebar, 0.35), (self.related, 0.2), (self.advert, 0.3), (self.comments, 0.4)):
            if self.maybe(p):
                middle.insert(0 if self.maybe(0.3) else len(middle), part())
        inside = "".join(middle)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            inside = self.el(self.r.choice(["div", "main", "section"]), inside, self.r.choice(["", self.name("container", "wrapper", "page", "content", "main", "layout")]), 1)
        parts = [x() for x, p in ((self.header, 0.5), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.4)) if self.maybe(p)]
        self.r.shuffle(parts)
        ends = [x() for x, p in ((self.form, 0.15), (self.footer, 0.8), (self.notice, 0.15)) if self.maybe(p)]
        script = f"<script>var a='</p>{self.words(1, 3)}';</script>" if self.maybe(0.5) else ""
        return f'<!DOCTYPE html><html data-y="1"><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body data-y="1">{script}{"".join(parts)}{inside}{"".join(ends)}</body></html>'


def labelled(page: str) -> tuple[list[Node], list[bool]]:
    """Nodes without the label attribute, and labels; a run of text has that of its element."""
    nodes, labels = parse(page), []
    for n in nodes:
        y = n.attrs.pop("data-y", None)
        labels.append(y == "1" if y is not None else n.parent >= 0 and labels[n.parent] if n.parent >= 0 else True)
    return nodes, labels


@lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 11) -> TreeModel:
    maker = PageMaker(seed)
    return TreeModel.train([labelled(maker.page()) for _ in range(pages)])


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: TreeModel | None = None) -> DataFrame:
    """``pages`` without the html, with the main text and its ``n_chars``; equal names are replaced; no shuffle."""
    model = model or trained()
    keep = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    fields = [pages.schema[c] for c in keep]
    slim = pages.select(*keep, pages[html_col].alias("__html"))
    evidence, edges = model.evidence, model.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TreeModel(evidence, edges)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                text = [m.extract(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, text_col, "n_chars"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return slim.mapInArrow(run, f"{plain}{', ' if plain else ''}{text_col} string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
