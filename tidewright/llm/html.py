"""Main text of web pages by a tree-structured graphical model.

A page is parsed to its DOM tree. Each block element, and each inline element
whose class, id or role tells what it is for, is a binary variable (content or
boilerplate) with a potential from its features (tag class, words in class, id
and role, what it stands under, link share, text length, punctuation);
parent-child potentials connect elements along the tree. Other inline elements
belong to their block. Sum-product message passing - leaves to root, then root
to leaves - gives every element's marginal; text belongs to the main text where
its element's marginal is above one half. Potentials are fitted on labelled
pages (``fit``): a logistic model over the features, and the table of parent and
child labels, whose weight is chosen by the errors on those pages.
``labelled_pages`` makes the pages of the default model, from rules.

Tags are read as browsers read them: quotes hold only after ``=``; where a
quote never ends, the tag ends at the next ``>``; a tag without an end takes the
rest of the page. Blocks: text between block-level tags; character references
are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by \\n. Scripts, styles and form controls never show; a form does
only where it holds most of the page's text.

Defined results: null, empty and text-free pages give the empty text; unclosed
and stray tags are handled; equal pages give equal texts; extra columns are
ignored; nothing is cut, whatever a page's length or depth, and the time grows
in proportion to the page.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import logistic, map_rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s>/]*)", re.S)
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul br".split())
NEVER = frozenset("script style noscript template textarea title head iframe svg math canvas object select option button input label legend xmp noembed noframes audio video".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

#: Words in class, id and role attributes, by what they say of an element.
HINTS = {
    "content": "article content main post story entry body text prose blog page markdown".split(),
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs crumbs toc pagination pager tabs links".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner affiliate dfp".split(),
    "side": "sidebar aside rail widget related recommended recommendations more trending popular".split(),
    "foot": "footer foot copyright legal colophon".split(),
    "head": "header masthead top logo brand toolbar".split(),
    "comment": "comment comments disqus reply replies discussion respond reader readers".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup login share social toast paywall".split(),
}
#: Words that make a class say how its element is shown, not what it is.
STATES = {
    "before": "has no is not with without hide hides hidden show shows sticky fixed enable disable without can js".split(),
    "after": "open opened closed enabled disabled fixed sticky underlined active inactive set unset on off in out visible hidden shown collapsed expanded page ready loaded left right layout".split(),
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws}
_STRONG = ("comment", "ad", "notice", "nav", "side", "foot", "head", "content")


class Node:
    __slots__ = ("children", "hint", "lead", "link", "marks", "own", "parent", "tag", "text", "under")

    def __init__(self, tag: str, hint: str, parent: Node | None):
        self.tag, self.hint, self.parent = tag, hint, parent
        self.children: list[Node] = []
        self.text = self.link = self.marks = self.own = 0
        self.lead = tag in ("h1", "article", "main") or hint == "content"
        self.under = "-" if parent is None else _kind(parent) or parent.under


_UNDER = {"article": "content", "main": "content", "nav": "nav", "menu": "nav", "footer": "foot", "aside": "side", "header": "head", "dialog": "notice", "form": "form"}


def _kind(n: Node) -> str:
    return n.hint or _UNDER.get(n.tag, "")


def _said(word: str) -> set[str]:
    """What a class word says; nothing where it tells a state (``has-sidebar``, ``comments-open``)."""
    pieces = [p.lower() for p in PIECES.findall(word)]
    if len(pieces) > 1 and (pieces[0] in STATES["before"] or pieces[-1] in STATES["after"]):
        return set()
    return {_HINT[p] for p in pieces if p in _HINT}


def _hint(attrs: str) -> str:
    """What class, id and role say an element is; nothing where one word says content and another something else."""
    if "=" not in attrs:
        return ""
    words = []
    for m in ATTR.finditer(attrs):
        if m.group(1).lower() in ("class", "id", "role", "itemprop", "aria-label"):
            words += [_said(w) for w in m.group(2).strip("\"'").split()]
    found = set().union(*words) if words else set()
    if {"content"} in words and any(w and "content" not in w for w in words):
        return ""
    return next((k for k in _STRONG if k in found), "")


def settle(nodes: list[Node]) -> None:
    """Take back what classes say against elements that hold the article.

    Those are html and body, and elements with at least half of the page's
    text outside links that have its h1, an article or the like in them.
    """
    for n in reversed(nodes[1:]):
        n.parent.lead |= n.lead
    half = (nodes[0].text - nodes[0].link) / 2
    for n in nodes[1:]:
        if n.hint not in ("", "content") and (n.tag in ("html", "body") or (n.lead and n.text and n.text - n.link >= half)):
            n.hint = ""
        n.under = _kind(n.parent) or n.parent.under


def parse(page: str) -> tuple[list[Node], list[tuple[Node | None, str, bool]]]:
    """(elements, parents first; runs in page order: (element, text, in a link), or (None, "", False) at a block boundary)."""
    root = Node("#root", "", None)
    nodes, runs, at, size = [root], [], 0, len(page)
    stack: list[tuple[str, Node, bool]] = [("#root", root, False)]
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
    blocks: list[int] = []  # depths of the open blocks that are no p
    quoted = True

    def close(depth: int) -> None:
        """Close the elements from ``depth`` on."""
        while len(stack) > depth:
            tag = stack.pop()[0]
            depths[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    def last(tags: tuple) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=-1)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            runs.append((stack[-1][1], page[at:lt], stack[-1][2]))
        if lt == size:
            break
        m = TOKEN.match(page, lt)
        if m is None:  # a bare "<"
            runs.append((stack[-1][1], "<", stack[-1][2]))
            at = lt + 1
            continue
        at = m.end()
        closing, opening = m.groups()
        if opening:
            rest = _REST.match(page, at) if quoted else None
            if rest is None:
                quoted = False  # from here on some quote does not end
                end = page.find(">", at)
                if end < 0:
                    break
                attrs, at = page[at:end], end + 1
            else:
                attrs, at = rest.group(1), rest.end()
            tag = opening.lower()
            if tag in BLOCK:
                runs.append((None, "", False))
            if tag in CLOSES_P:
                if depths["p"] and depths["p"][-1] > (blocks[-1] if blocks else -1):
                    close(depths["p"][-1])
            elif tag in SIBLINGS:
                up = last(SIBLINGS[tag])
                if up > last(SCOPE[tag]):
                    if tag == "tr" and depths["tr"] and depths["tr"][-1] > last(SCOPE["tr"]):
                        up = depths["tr"][-1]
                    close(up)
            if tag in VOID:
                continue
            hint = _hint(attrs)
            here = stack[-1]
            if tag in BLOCK or tag in NEVER or hint:
                node = Node(tag, hint, here[1])
                here[1].children.append(node)
                nodes.append(node)
            else:
                node = here[1]
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:  # its text is not markup
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
                continue
            depths[tag].append(len(stack))
            if tag in BLOCK and tag != "p":
                blocks.append(len(stack))
            stack.append((tag, node, tag == "a" or (here[2] and tag not in BLOCK)))
        elif closing:
            tag = closing.lower()
            if tag in BLOCK:
                runs.append((None, "", False))
            # an inline element's end does not close the blocks inside it
            if depths[tag] and (tag in BLOCK or depths[tag][-1] > max(blocks[-1] if blocks else -1, depths["p"][-1] if depths["p"] else -1)):
                close(depths[tag][-1])
    return nodes, runs


def measure(nodes: list[Node], runs: list[tuple[Node | None, str, bool]]) -> None:
    for n, t, link in runs:
        if n is not None and not t.isspace():
            k = len(t)
            n.text += k
            n.own += k
            n.marks += t.count(".") + t.count(",")
            if link:
                n.link += k
    for n in reversed(nodes[1:]):
        p = n.parent
        p.text += n.text
        p.link += n.link
        p.marks += n.marks
    settle(nodes)


_INLINE = "inline"
_CLASS = {"article": "article", "main": "main", "nav": "nav", "footer": "footer", "header": "header", "aside": "aside", "p": "p", "li": "li", "ul": "ul", "ol": "ul", "div": "div", "section": "div", "center": "div", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "cell", "td": "cell", "th": "cell", "tr": "cell", "blockquote": "quote", "pre": "quote", "dl": "ul", "dt": "li", "dd": "li", "figure": "figure", "figcaption": "figure", "body": "body", "html": "html", "dialog": "notice", "menu": "nav", "form": "form"}


def features(n: Node) -> tuple[str, ...]:
    tag = "never" if n.tag in NEVER else "heading" if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit() else _CLASS.get(n.tag, _INLINE)
    text = 0 if not n.text else min(6, int(math.log2(1 + n.text / 20)) + 1)
    share = 0 if not n.text else int(4 * n.link / n.text + 0.5)
    marks = 0 if not n.text else min(3, int(40 * n.marks / n.text + 0.5))
    where = "good" if n.under == "content" else "none" if n.under == "-" else "bad"
    return (f"tag {tag}", f"hint {n.hint or '-'}", f"under {n.under}", f"size {text}", f"link {share}", f"marks {marks}", f"{where} {tag}", f"{where} link {share}", f"{where} size {text}")


class Model:
    """Log odds content : boilerplate by feature; parent-child potentials as (parent, child) logs."""

    def __init__(self, unary: dict[str, float], pair: tuple[tuple[float, float], tuple[float, float]]):
        self.unary, self.pair = unary, pair

    def potential(self, n: Node) -> float:
        u = self.unary
        return u.get("", 0.0) + sum(u.get(x, 0.0) for x in features(n))

    def marginals(self, nodes: list[Node]) -> dict[int, float]:
        """Each element's log odds of content, by sum-product: upward, then downward."""
        (p00, p01), (p10, p11) = self.pair
        e = [[math.exp(p00), math.exp(p01)], [math.exp(p10), math.exp(p11)]]
        own = {id(n): self.potential(n) for n in nodes}
        up, total = {}, dict(own)  # log odds: messages to parents; own potential and all children's messages

        def through(x: float, a: float, b: float, c: float, d: float) -> float:
            """The log odds of a neighbour, from one side's log odds x: log((b + d*e^x) / (a + c*e^x))."""
            if x > 0:
                t = math.exp(-min(x, 700.0))
                return math.log((b * t + d) / (a * t + c))
            t = math.exp(max(x, -700.0))
            return math.log((b + d * t) / (a + c * t))

        for n in reversed(nodes[1:]):
            m = up[id(n)] = through(total[id(n)], e[0][0], e[1][0], e[0][1], e[1][1])
            total[id(n.parent)] += m
        for n in nodes[1:]:
            rest = total[id(n.parent)] - up[id(n)]
            total[id(n)] += through(rest, e[0][0], e[0][1], e[1][0], e[1][1])
        return total


def hidden(nodes: list[Node]) -> dict[int, bool]:
    """Whether an element is, or is in, one that never shows text of the article."""
    shut: dict[int, bool] = {}
    most = nodes[0].text / 2
    for n in nodes:
        shut[id(n)] = n.tag in NEVER or (n.tag == "form" and n.text < most) or (n.parent is not None and shut[id(n.parent)])
    return shut


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, runs = parse(page)
    measure(nodes, runs)
    odds, shut = model.marginals(nodes), hidden(nodes)
    blocks, part = [], []
    for n, t, _ in (*runs, (None, "", False)):
        if n is None:
            if part:
                b = " ".join(_html.unescape("".join(part)).split())
                if b:
                    blocks.append(b)
                part = []
        elif odds[id(n)] > 0 and not shut[id(n)]:
            part.append(t)
    return "\n".join(blocks)


# ------------------------------------------------------------------ training


def _logistic(rows: list[tuple], y: np.ndarray, ridge: float = 2.0) -> dict[str, float]:
    """Weights of one-hot features; "" is the constant."""
    names = sorted({f for r in rows for f in r})
    at = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        for f in r:
            x[i, at[f]] = 1
    beta = logistic(x, y, ridge)
    return {"": float(beta[0]), **{f: float(beta[i]) for f, i in at.items()}}


def _side(text: str, marks: set[str]) -> int:
    """Words of the main text less others."""
    good = sum(w.strip(".,") in marks for w in text.split())
    return 2 * good - len(text.split())


def fit(pages: list[tuple[str, set[str]]]) -> Model:
    """Learn from labelled pages: (html, marks); an element most of whose words are marks is content.

    A mark is a word that stands only in the main text of the page.
    """
    rows, labels, pair, parsed = [], [], Counter(), []
    for page, marks in pages:
        nodes, runs = parse(page)
        measure(nodes, runs)
        good: dict[int, int] = defaultdict(int)
        for n, t, _ in runs:
            if n is not None:
                good[id(n)] += _side(t, marks)
        for n in reversed(nodes[1:]):
            good[id(n.parent)] += good[id(n)]
        label = {id(n): int(good[id(n)] > 0) for n in nodes}
        parsed.append((nodes, runs, marks))
        for n in nodes[1:]:
            if n.tag not in ("html", "head", "title") and n.tag not in NEVER:
                rows.append(features(n))
                labels.append(label[id(n)])
                if n.parent.tag not in ("#root", "html"):
                    pair[label[id(n.parent)], label[id(n)]] += 1
    unary = _logistic(rows, np.array(labels, dtype=float))
    total = sum(pair.values()) + 4
    logs = tuple(tuple(math.log((pair[a, b] + 1) / total) for b in (0, 1)) for a in (0, 1))
    norm = tuple(tuple(logs[a][b] - (logs[a][0] + logs[a][1]) / 2 - (logs[0][b] + logs[1][b]) / 2 for b in (0, 1)) for a in (0, 1))
    # features of a parent and its child overlap: how much the coupling counts for is chosen by errors on the pages
    models = [Model(unary, tuple(tuple(w * v for v in row) for row in norm)) for w in (0.25, 0.5, 1.0, 1.5, 2.0)]
    return min(models, key=lambda m: sum(_errors(*x, m) for x in parsed))


def _errors(nodes: list[Node], runs: list, marks: set[str], model: Model) -> float:
    """Runs of text on the wrong side, by the margin that is missing."""
    odds, shut = model.marginals(nodes), hidden(nodes)
    return sum(max(0.0, 1.0 - (1 if _side(t, marks) > 0 else -1) * odds[id(n)]) for n, t, _ in runs if n is not None and not t.isspace() and not shut[id(n)])


def labelled_pages(n: int = 400, seed: int = 7, held_out: bool = False) -> list[tuple[str, set[str]]]:
    """Pages made from rules, with the words of their main text; ``held_out`` pages have layouts and parts that the others do not have."""
    r = random.Random(seed)
    parts = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "ne", "pi", "ro", "su", "ta"]
    word = lambda p: p + "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    pages = []
    for _ in range(n):
        marks: set[str] = set()

        def main(k, marks=marks):
            ws = [word("m") for _ in range(k)]
            marks.update(ws)
            return " ".join(w + (r.choice([".", ","]) if r.random() < 0.12 else "") for w in ws) + r.choice([".", ".", "."] if k > 12 else [".", ""])

        def other(k):
            return " ".join(word("x") + ("." if r.random() < 0.06 else "") for _ in range(k))

        def links(k):
            return "<ul>" + "".join(f'<li><a href="/{i}">{other(r.randint(1, 3))}</a></li>' for i in range(k)) + "</ul>"

        def linked(k):
            return f'<a href="/{r.randint(1, 99)}">{main(k)}</a>'

        common = [
            *[lambda: f"<p>{main(r.choice([1, 3, 8, 30, 60, 90]))}" + r.choice(["</p>", "</p>", "<br>"])] * 14,
            lambda: f"<p><b>{main(12)}</b> {main(20)} <a href='#'>{main(2)}</a> {main(9)}</p>",
            lambda: f"<p>{main(3)} {linked(2)}, {linked(1)}, {linked(2)} {main(1)} {linked(2)}</p>",
            lambda: "<ul>" + "".join(f"<li>{main(8)}</li>" for _ in range(3)) + "</ul>",
            lambda: "<ul>" + "".join(f"<li>{linked(4)}</li>" for _ in range(r.randint(2, 5))) + f"<li>{main(6)}</li></ul>",
            lambda: f"<blockquote><p>{main(14)}</p></blockquote>",
            lambda: f"<h2>{main(4)}</h2><pre>{main(10)}</pre>",
            lambda: f"<h2>{linked(5)}</h2><p>{main(25)}</p>",
            lambda: "<table>" + "".join(f"<tr><th>{main(1)}</th><td>{main(3)}</td><td>{main(1)}</td></tr>" for _ in range(3)) + "</table>",
            lambda: f"<div><p>{main(40)}</p></div>",
            lambda: f"<figure><img src=a.png><figcaption>{main(7)}</figcaption></figure>",
            lambda: f'<div class="{r.choice(["ad", "promo", "newsletter"])}">{other(9)}</div>',
        ]
        rare = [
            *[lambda: f"<p>{main(r.choice([2, 12, 45]))}</p>"] * 5,
            lambda: "<ol>" + "".join(f"<li>{main(3)} {linked(6)}</li>" for _ in range(4)) + "</ol>",
            lambda: f"<dl><dt>{main(2)}</dt><dd>{main(11)}</dd></dl>",
            lambda: "<table><tr>" + "".join(f"<td>{linked(2)}</td>" for _ in range(3)) + f"</tr><tr><td>{main(8)}</td></tr></table>",
            lambda: f"<h3>{main(3)}</h3><div>{main(30)}<br><br>{main(22)}</div>",
            lambda: f'<aside class="related">{links(3)}</aside>',
        ]

        def body():
            h = r.random()
            out = [f"<h1>{main(r.randint(2, 9))}</h1>" if h < 0.7 else f"<h1>{linked(5)}</h1>" if h < 0.8 else f"<header><h1>{main(5)}</h1></header>"] if r.random() < 0.9 else []
            return "".join(out + [r.choice(rare if held_out else common)() for _ in range(r.randint(1, 9))])

        around = [
            lambda: f"<nav>{links(r.randint(3, 9))}</nav>",
            lambda: f'<div class="{r.choice(["menu", "navbar", "breadcrumb"])}">{links(4)}</div>',
            lambda: f'<div class="{r.choice(["ad", "sponsored", "banner"])}">{other(r.randint(4, 30))}</div>',
            lambda: f"<aside>{other(6)}{links(3)}<p>{other(20)}</p></aside>",
            lambda: f'<div class="sidebar"><h3>{other(2)}</h3><p>{other(25)}</p></div>',
            lambda: f'<div id="cookie-notice"><p>{other(18)}</p><button>{other(1)}</button></div>',
            lambda: f"<form><label>{other(2)}</label><input><p>{other(5)}</p></form>",
            lambda: f"<header><p>{other(5)}</p></header>",
            lambda: f"<header><h2>{other(2)}</h2>{links(4)}</header>",
            lambda: links(r.randint(4, 9)),
        ]
        after = [
            lambda: f"<footer>{other(r.randint(4, 30))}</footer>",
            lambda: f"<footer><p>{other(12)}</p>{links(3)}</footer>",
            lambda: '<section class="comments">' + "".join(f"<div class='comment'><p>{other(r.randint(4, 40))}</p></div>" for _ in range(3)) + "</section>",
            lambda: f'<div id="comments"><ul><li><p>{other(30)}</p></li></ul></div>',
            lambda: f'<div class="related">{links(4)}</div>',
        ]
        if held_out:
            around += [lambda: f'<div role="navigation"><p>{"".join(f"<a href=/{i}>{other(1)}</a> | " for i in range(6))}</p></div>', lambda: f'<table class="toolbar"><tr><td>{other(2)}</td><td><a href=/>{other(1)}</a></td></tr></table>']
            after += [lambda: f'<div class="site-footer"><p>{other(9)}</p></div>', lambda: f'<ol id="replies"><li>{other(25)}</li><li>{other(12)}</li></ol>']
            shell = r.choice([('<section class="blog-post">', "</section>"), ("<form action=/><div><article>", "</article></div></form>"), ('<div id="wrap"><div role="main">', "</div></div>"), ('<table><tr><td class="story">', "</td></tr></table>"), ("<article><section>", "</section></article>")])
        else:
            shell = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div class="post"><div class="entry">', "</div></div>"), ("<div>", "</div>"), ("<form><main>", "</main></form>")])
        page = f"<html><head><title>{other(4)}</title><style>p{{}}</style></head><body>" + "".join(f() for f in r.sample(around, r.randint(1, 4))) + shell[0] + body() + shell[1] + "".join(f() for f in r.sample(after, r.randint(1, 3))) + "</body></html>"
        pages.append((page, marks))
    return pages


def quality(pages: list[tuple[str, set[str]]], model: Model) -> tuple[float, float]:
    """(precision, recall) over the words of labelled pages."""
    kept = right = there = 0
    for page, marks in pages:
        words = [w.strip(".,") for w in extract(page, model).split()]
        kept, right = kept + len(words), right + sum(w in marks for w in words)
        there += sum(w.strip(".,") in marks for w in re.sub(r"<[^>]*>", " ", page).split())
    return right / max(1, kept), right / max(1, there)


_DEFAULT: list[Model] = []


def default_model() -> Model:
    if not _DEFAULT:
        _DEFAULT.append(fit(labelled_pages()))
    return _DEFAULT[0]


def main_text(df: DataFrame, model: Model | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and its length in code points, for each row of ``df``."""
    model = model or default_model()
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, url)}

    def make():
        def f(cols):
            texts = [extract(t, model) for t in cols[2]]
            return [cols[0], cols[1], texts, list(map(len, texts))]

        return f

    return map_rows(df.select(F.col(key), F.col(url), F.col(html)), f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars long", make)
