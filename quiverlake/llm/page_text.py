"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements whose leaves are runs of inline text.
Every node is content or boilerplate. A node's own potential is linear in its
tag, its class and id words and the shape of its text; an edge's potential
depends on both labels and on the child's kind. Messages passed upward from
the leaves and downward from the root give each node's exact marginal, and the
text runs that are content with at least even odds make the text. Weights are
fitted to labelled pages by gradient steps on the exact likelihood, whose
gradient the same two passes give.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

from pyspark.sql import DataFrame, SparkSession

from .common import fold_rows, table

#: HTML's own lists. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("head script style title template svg math iframe object noscript textarea select datalist canvas audio video xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul button".split()
)
#: Start tags that end an open p, and those that end an open element of the same list first.
ENDS_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption legend summary button".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section body html main nav aside header footer blockquote form td th".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
MARKS = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that may stand in head; any other start tag ends it. Fixed value.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())


class Node:
    """An element, or a run of inline text (tag '#'). Children follow their parent in page order."""

    __slots__ = ("tag", "up", "names", "text", "linked", "kids")

    def __init__(self, tag: str, up: int, names: list[str]) -> None:
        self.tag, self.up, self.names, self.text, self.linked, self.kids = tag, up, names, "", 0, 0


def marks(attributes: str) -> list[str]:
    """Words of class, id, role and itemprop, and signs that an element is hidden."""
    out = []
    for m in MARKS.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            out.append("!hidden")
        elif key not in ("style", "aria-hidden"):
            out += [w.lower() for w in NAME.findall(CAMEL.sub(" ", value))]
    return out


class Open:
    """The open block elements (tag, node), and the places of each tag among them, so that no search depends on the depth."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = [("html", 0)]
        self._places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        """Place of the innermost of these tags, 0 where none is open."""
        return max((p[-1] for t in tags if (p := self._places.get(t))), default=0)

    def push(self, tag: str, node: int) -> None:
        self._places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, node))

    def cut(self, place: int) -> None:
        """Closes what stands from a place on."""
        while len(self.items) > place:
            self._places[self.items.pop()[0]].pop()


def parse(page: str) -> list[Node]:
    """Nodes of a page in page order; the first is the root.

    Missing end tags are implied, unknown end tags ignored. A head ends where
    something begins that can't stand in it, and a hidden element that isn't
    closed where an element about it is.
    """
    nodes = [Node("html", -1, [])]
    stack = Open()
    hidden: list[str] = []  # open hidden elements, and block elements in them
    parts: list[str] = []
    linked = links = 0
    raw = ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = Node("#", stack.items[-1][1], [])
            n.text, n.linked = text, linked
            nodes.append(n)
            nodes[n.up].kids += 1
        parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        if raw:
            m = re.compile(rf"</{raw}\b[^>]*>?", re.I).search(page, at)
            at = m.end() if m else size
            raw = ""
            continue
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if hidden == ["head"] and text.strip():
            hidden.clear()
        if text and not hidden:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = (m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if hidden:
            if not end and tag not in IN_HEAD and all(h in ("head", "noscript") for h in hidden) and hidden[0] == "head":
                hidden.clear()
            elif end and tag not in hidden and tag in BLOCK and stack.last(tag):
                hidden.clear()
            else:
                if end and tag in hidden:
                    while hidden.pop() != tag:
                        pass
                elif not end and tag in RAW:
                    raw = tag
                elif not end and (tag in HIDDEN or tag in BLOCK) and not attributes.endswith("/"):
                    hidden.append(tag)
                continue
        if end:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                links = 0
                if place := stack.last(tag):
                    stack.cut(place)
            continue
        if tag in RAW:
            raw = tag
            parts.append(" ")
        elif tag in HIDDEN:
            if not attributes.endswith("/"):
                hidden.append(tag)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK and tag not in ("html",):
            flush()
            links = 0
            if tag in ENDS_P and (place := stack.last("p")) and stack.last("button", "td", "th", "table") < place:
                stack.cut(place)
            if tag in SIBLINGS:
                while (place := stack.last(*SIBLINGS[tag])) > stack.last(*(SCOPES - SIBLINGS[tag])):
                    stack.cut(place)
            n = Node(tag, stack.items[-1][1], marks(attributes))
            nodes[n.up].kids += 1
            nodes.append(n)
            if tag not in VOID:
                stack.push(tag, len(nodes) - 1)
    flush()
    return nodes


def features(n: Node, parent: str) -> list[str]:
    """What a node's own potential sees."""
    if n.tag != "#":
        return ["tag " + n.tag, *{"name " + w for w in n.names}]
    words = n.text.count(" ") + 1
    share = n.linked / max(1, len(n.text))
    return [
        "text",
        "in " + parent,
        "words " + ("1-2" if words < 3 else "3-9" if words < 10 else "10-29" if words < 30 else "30-"),
        "links " + ("none" if not share else "some" if share < 0.5 else "most"),
        "sentence" if n.text[-1:] in ".!?…\"”»" else "no sentence",
    ]


def edge_kind(n: Node) -> str:
    return "text" if n.tag == "#" else "named" if n.names else "plain" if n.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table", "tbody", "tr", "td", "div") else "other"


def marginals(nodes: list[Node], own: list[float], edges: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(content) of each node and P(parent label, child label) of each edge as (00, 01, 10, 11), by sum-product up and down the tree.

    own: log odds of content; edges: log potentials for (00, 01, 10, 11), the
    root's counting for nothing. Messages are scaled, so depth doesn't matter.
    """
    n = len(nodes)
    b0, b1 = [1.0] * n, [1.0] * n  # products of what has come from below, own potential included
    m0, m1 = [1.0] * n, [1.0] * n  # message to the parent
    pot = [tuple(math.exp(x) for x in e) for e in edges]
    for k in range(n - 1, -1, -1):
        x = max(-30.0, min(30.0, own[k]))
        p1 = 1 / (1 + math.exp(-x))
        a, b = b0[k] * (1 - p1), b1[k] * p1
        s = a + b
        b0[k], b1[k] = a, b = a / s, b / s
        if k:
            f = pot[k]
            u, v = f[0] * a + f[1] * b, f[2] * a + f[3] * b
            s = u + v
            m0[k], m1[k] = u, v = u / s, v / s
            up = nodes[k].up
            a, b = b0[up] * u, b1[up] * v
            s = a + b
            b0[up], b1[up] = a / s, b / s
    out = [0.0] * n
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    d0, d1 = [1.0] * n, [1.0] * n  # belief with everything included
    for k in range(n):
        if not k:
            d0[0], d1[0] = b0[0], b1[0]
        else:
            up, f = nodes[k].up, pot[k]
            # what the parent believes without this child
            u, v = d0[up] / max(m0[k], 1e-300), d1[up] / max(m1[k], 1e-300)
            w = (u * f[0] * b0[k], u * f[1] * b1[k], v * f[2] * b0[k], v * f[3] * b1[k])
            s = sum(w) or 1.0
            pairs[k] = w = (w[0] / s, w[1] / s, w[2] / s, w[3] / s)
            d0[k], d1[k] = w[0] + w[2], w[1] + w[3]
        out[k] = d1[k] / (d0[k] + d1[k])
    return out, pairs


class PageModel:
    """Weights of own and edge potentials."""

    def __init__(self) -> None:
        self.own: dict[str, float] = {}
        self.edge: dict[str, list[float]] = {}

    def potentials(self, nodes: list[Node]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        own, edge, zero = self.own.get, self.edge.get, (0.0, 0.0, 0.0, 0.0)
        return (
            [sum(own(f, 0.0) for f in features(n, nodes[n.up].tag if n.up >= 0 else "")) for n in nodes],
            [tuple(edge(edge_kind(n), zero)) for n in nodes],
        )

    def text(self, page: str | None) -> str:
        nodes = parse(page or "")
        p, _ = marginals(nodes, *self.potentials(nodes))
        return "\n\n".join(n.text for n, x in zip(nodes, p) if n.tag == "#" and x >= 0.5)


def fit(pages: list[tuple[list[Node], list[int]]], rounds: int = 60, rate: float = 0.3, shrink: float = 0.002) -> PageModel:
    """Maximum likelihood of labelled trees by scaled gradient steps, with a small quadratic penalty."""
    model = PageModel()
    feats = [[features(n, nodes[n.up].tag if n.up >= 0 else "") for n in nodes] for nodes, _ in pages]
    kinds = [[edge_kind(n) for n in nodes] for nodes, _ in pages]
    size: dict = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        egrad: dict[str, list[float]] = {}
        for (nodes, labels), fs, ks in zip(pages, feats, kinds):
            p, pairs = marginals(nodes, *model.potentials(nodes))
            for k, n in enumerate(nodes):
                d = labels[k] - p[k]
                for f in fs[k]:
                    grad[f] = grad.get(f, 0.0) + d
                if k:
                    g = egrad.setdefault(ks[k], [0.0] * 4)
                    for i in range(4):
                        g[i] -= pairs[k][i]
                    g[2 * labels[n.up] + labels[k]] += 1
        for f, g in grad.items():
            g = g / len(pages) - shrink * model.own.get(f, 0.0)
            size[f] = size.get(f, 1e-8) + g * g
            model.own[f] = model.own.get(f, 0.0) + rate * g / math.sqrt(size[f])
        for kind, gs in egrad.items():
            w = model.edge.setdefault(kind, [0.0] * 4)
            for i, g in enumerate(gs):
                g = g / len(pages) - shrink * w[i]
                size[kind, i] = size.get((kind, i), 1e-8) + g * g
                w[i] = max(-8.0, min(8.0, w[i] + rate * g / math.sqrt(size[kind, i])))
    return model


#: Names that sites give to parts of a page, for the labelled pages below. Fixed values.
GOOD_BOXES = ["<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post entry-content">', '<section class="article-body">', '<div role="main">', '<div class="story text">', "<section>", '<div itemprop="articleBody">', "<div>"]
MENUS = ["<nav>", '<div class="menu">', '<div id="navigation">', '<ul class="nav navbar">', '<div class="breadcrumbs">', '<div role="navigation">', '<div class="tabs links">', '<div class="pagination pager">', '<div class="topbar">', '<div class="tags">']
HEADS = ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header banner">', '<div class="logo branding">', '<div class="top">']
FOOTS = ["<footer>", '<div class="footer">', '<div id="site-footer">', '<div class="copyright legal">', '<div role="contentinfo">', '<div class="bottom imprint">']
SIDES = ["<aside>", '<div class="sidebar">', '<div id="side">', '<div class="widget">', '<div class="related">', '<section class="recommended more-stories">', '<div role="complementary">', '<div class="trending popular">', '<div class="author-bio">', '<section class="related-posts">']
ADVERTS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<section class="promo">', '<div id="banner-ad">', '<aside class="ad">', '<div class="sponsor">', '<p class="ad">', '<p class="promo">', '<p class="sponsored">']
NOTICES = ['<div class="cookie">', '<div class="cookie-notice">', '<div id="cookies">', '<div class="consent gdpr">', '<div class="notice">', '<div class="alert">', '<div class="modal popup">', '<div role="dialog">', '<div class="newsletter subscribe signup">', '<div role="alert">', "<dialog>", '<p class="notice">', '<p class="cookie">', '<div class="disclaimer">', '<div class="paywall">']
FORMS = ["<form>", '<form class="search">', '<form id="subscribe">', '<form class="login">', '<div class="search">', "<fieldset>"]
REMARKS = ['<div class="comments">', '<section id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="replies responses">', '<div id="disqus">', '<section class="discussion">', '<div class="reader-comments">', '<ul class="comments">', '<article class="comment">', '<div class="reviews">', '<div class="feedback">']
SHARES = ['<div class="share">', '<div class="social">', '<ul class="social share-buttons">', '<div class="byline-links">', '<div class="toolbar">']


def labelled_pages(count: int = 240, seed: int = 7) -> list[tuple[list[Node], list[int]]]:
    """Labelled pages from a rule: invented words in the layouts that sites use, parsed, with each node's label.

    A run of text is content if it was written as the article; an element is,
    if any text below it is.
    """
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)).capitalize()

    def sentence(lo: int, hi: int) -> str:
        return words(rng.randint(lo, hi)) + rng.choice(["."] * 8 + ["!", "?", ""])

    def close(tag: str) -> str:
        return f"</{re.match(r'<(\w+)', tag)[1]}>"

    def paragraph() -> str:
        text = " ".join(sentence(1, 12) for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))
        odd = rng.random()
        if odd < 0.06:  # lists of words and stutter are found in articles too
            text = " ".join([words(1)] * rng.randint(2, 60))
        elif odd < 0.12:
            text = " | ".join(words(1) for _ in range(rng.randint(2, 20)))
        elif odd < 0.18:
            text = words(rng.randint(1, 4))
        if rng.random() < 0.2:
            text = f"<b>{text}" + rng.choice(["</b>", "<br>"])
        if rng.random() < 0.15:
            text += f' <a href="/x">{words(2)}</a> ' + sentence(2, 6)
        return text

    def body() -> str:
        out = [f"<h1>{sentence(2, 10)}</h1>"] if rng.random() < 0.8 else []
        dull = rng.random() < 0.15  # a long text of short lines
        for _ in range(rng.choice([30, 60, 120]) if dull else rng.choice([1, 2, 3, 6, 12])):
            kind = rng.random() * (0.74 if dull else 1)
            if kind < 0.74:
                out.append(f"<p>{paragraph()}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.80:
                out.append(f"<h2>{words(rng.randint(1, 6))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence(1, 9)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote>{rng.choice(['<p>', ''])}{sentence(4, 15)}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(1)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f"<pre>{words(rng.randint(2, 12))}</pre>")
            else:
                out.append(f"<figure><figcaption>{sentence(3, 9)}</figcaption></figure>")
        return "".join(out)

    def junk(lo: int = 0) -> str:
        kind = rng.choice([MENUS, MENUS, HEADS, FOOTS, SIDES, ADVERTS, NOTICES, FORMS, REMARKS, SHARES])
        tag = rng.choice(kind)
        item = lambda: f'<a href="/y">{words(rng.randint(1, 3))}</a>'
        if kind in (MENUS, SHARES):
            inner = "<ul>" * (not tag.startswith(("<ul", "<ol"))) + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 7))) + "</ul>" * (not tag.startswith(("<ul", "<ol")))
        elif kind is HEADS:
            inner = rng.choice([f"<h1>{words(2)}</h1>", f"<p>{words(4)}</p>", item(), f"<h2>{words(2)}</h2><p>{sentence(3, 8)}</p>"]) + (rng.choice(["", f"<nav><ul><li>{item()}</li></ul></nav>"]))
        elif kind is FOOTS:
            inner = rng.choice([f"&copy; {words(3)} &middot; {sentence(4, 20)}", f"<p>{sentence(4, 20)}</p>", f"<ul><li>{item()}</li><li>{item()}</li></ul><p>&copy; {words(2)}</p>"])
        elif kind is FORMS:
            inner = f"<label>{words(2)}</label><input name=q><button>{words(1)}</button>" + rng.choice(["", f"<p>{sentence(3, 9)}</p>"])
        elif kind is REMARKS:
            one = lambda: rng.choice([f"<p>{paragraph()}</p>", f"<div class=\"comment\"><b>{words(1)}</b><p>{paragraph()}</p></div>", f"<li><p>{paragraph()}</p></li>"])
            inner = rng.choice(["", f"<h2>{words(1)}</h2>", f"<h3>{words(2)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 4)))
        elif kind is SIDES:
            inner = rng.choice(["", f"<h3>{words(2)}</h3>"]) + rng.choice(["<ul>" + "".join(f"<li>{item()}</li>" for _ in range(3)) + "</ul>", f"<p>{paragraph()}</p>"])
        elif tag.startswith("<p"):
            inner = sentence(3, 20)
        else:
            inner = rng.choice([sentence(3, 20), f"<p>{paragraph()}</p>", f"<p>{sentence(2, 9)}</p><button>{words(1)}</button>"])
        return tag + inner + close(tag)

    made = []
    for _ in range(count):
        box = rng.choice(GOOD_BOXES)
        good = body()
        if rng.random() < 0.35:  # parts that don't belong stand inside the article too
            cut = good.find("<p>", len(good) // 2)
            if cut > 0:
                good = good[:cut] + "\x01" + junk() + "\x02" + good[cut:]
        if rng.random() < 0.2:
            good += "\x01" + junk() + "\x02"
        page = "".join("\x01" + junk() + "\x02" for _ in range(rng.randint(0, 4))) + box + good + close(box) + "".join("\x01" + junk() + "\x02" for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.3:
            page = '<div class="' + rng.choice(["wrapper", "page", "container", "site", "layout row"]) + '">' + page + "</div>"
        # where junk begins and ends: its texts carry a mark that is taken off again
        flagged, depth = [], 0
        for piece in re.split(r"([\x01\x02])", "<body>" + page + "</body>"):
            if piece in ("\x01", "\x02"):
                depth += 1 if piece == "\x01" else -1
            else:
                flagged.append(re.sub(r">([^<]+)", ">\x03\\1", piece) if depth else piece)
        nodes = parse("".join(flagged))
        labels = [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            n = nodes[k]
            if n.tag == "#":
                labels[k] = int("\x03" not in n.text)
                n.text = n.text.replace("\x03", "") or "x"
            if labels[k] and n.up >= 0:
                labels[n.up] = 1
        made.append((nodes, labels))
    return made


@functools.cache
def trained() -> PageModel:
    return fit(labelled_pages())


def main_text(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars. Null html counts as empty and gives an empty text; whole pages are read; repeated rows come out as often; other columns are ignored."""
    model = model or trained()

    def run(batches):
        for b in batches:
            for page_id, url, page in zip(b["page_id"], b["url"], b["html"]):
                text = model.text(page)
                yield page_id, url, text, len(text)

    return fold_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", run, 256)


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; odd rows as main_text says."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_page_text": op5_page_text}
ORACLE: dict = {}
