"""Pages written by hand: classes on the containers of an article, and boilerplate that must go all the same."""

import re

import pytest

from tidewright.llm import html

STATES = "has-sidebar,no-sidebar,right-sidebar post,sticky-header,has-ads,nav-fixed,modal-closed,comments-open,cookies-not-set,login-page,share-enabled,links-underlined,logged-in admin-bar,social-share comments-open,with-sidebar,header-fixed,sidebar-right,newsletter-enabled,no-js".split(",")
LONG = "The harbour of the old town was rebuilt in stone, after the storm of that winter had taken the wooden piers and most of the boats."
TEXT = ["A title of a page", LONG, LONG.replace("harbour", "market") + " Nobody had expected it."]
BODY = f"<h1>{TEXT[0]}</h1><p>{TEXT[1]}</p><p>{TEXT[2]}</p>"


@pytest.mark.parametrize("place", ["html", "body", "article", "div", "article article"])
@pytest.mark.parametrize("name", STATES)
def test_classes_of_containers(place, name):
    """A class of the element around the article costs no text."""
    cls = f'class="{name}"'
    page = {
        "html": f"<html {cls}><body>{BODY}</body></html>",
        "body": f"<html><body {cls}>{BODY}</body></html>",
        "article": f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav><article {cls}>{BODY}</article><footer>All rights reserved.</footer></body></html>",
        "div": f"<html><body><div {cls}>{BODY}</div></body></html>",
        "article article": f'<html><body><article class="article {name}">{BODY}</article></body></html>',
    }[place]
    assert html.extract(page, html.default_model()) == "\n".join(TEXT)


HAND = [
    # a news page: menus, a sidebar of teasers, an advert within, comments behind
    f'<!DOCTYPE html><html class="no-js"><head><title>x</title></head><body class="single has-sidebar comments-open"><header class="site-header"><a href="/">Daily Paper</a><nav class="main-nav"><ul><li><a href="/w">World</a></li><li><a href="/s">Sports</a></li></ul></nav></header><main class="right-sidebar post"><article class="share-enabled">{BODY}<div class="ad">Buy one and get another for free today</div><p>{LONG}</p></article></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten reasons to stay</a></li><li><a href="/2">Rain again</a></li></ul></aside><section id="comments"><div class="comment"><p>I was there and it was not like that at all, believe me.</p></div></section><footer class="site-footer">Contact us, imprint</footer></body></html>',
    # a blog with tables for layout
    f'<html><body class="links-underlined nav-fixed"><div id="page"><div class="navbar"><a href="/">Start</a> <a href="/a">Archive</a></div><div class="blog-post">{BODY}<p>{LONG}</p></div><div id="cookie-notice"><p>We use cookies to make this site work.</p></div><div class="footer-links"><a href="/i">Imprint</a></div></div></body></html>',
    # comments that outweigh the article
    f'<html><body class="login-page"><article>{BODY}<p>{LONG}</p></article><section class="comments">' + "".join(f'<div class="comment"><p>Reader number {i} thinks that this is all wrong, and says so at some length, again and again, as readers do.</p></div>' for i in range(12)) + "</section></body></html>",
]


@pytest.mark.parametrize("page", HAND)
def test_pages_by_hand(page):
    got = html.extract(page, html.default_model())
    assert got == "\n".join([*TEXT, LONG])


def brute_marginals(nodes, model):
    """All labellings of a small tree, weighed."""
    import itertools
    import math

    own, at = [model.potential(n) for n in nodes], {id(n): i for i, n in enumerate(nodes)}
    total = [[0.0, 0.0] for _ in nodes]
    for y in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(u * v for u, v in zip(own, y, strict=True)) + sum(model.pair[y[at[id(n.parent)]]][y[i]] for i, n in enumerate(nodes) if n.parent is not None))
        for i, v in enumerate(y):
            total[i][v] += w
    return [math.log(b / a) for a, b in total]


@pytest.mark.parametrize("page", [f'<body class="no-sidebar"><div class="ad"><p>Buy now</p></div>{BODY}</body>', f"<div><nav><a href=/>x</a></nav><div class='story comments-open'>{BODY}</div></div>", f"<table><tr><td>{BODY}<td class=sidebar>Old news</table>"])
def test_text_by_all_labellings(page):
    """What is extracted is the text of the elements that are content in more than half of the weighed labellings."""
    model = html.default_model()
    nodes, runs = html.parse(page)
    html.measure(nodes, runs)
    assert len(nodes) < 14
    odds = dict(zip(map(id, nodes), brute_marginals(nodes, model), strict=True))
    shut = html.hidden(nodes)
    want = [t for n, t, _ in runs if n is not None and odds[id(n)] > 0 and not shut[id(n)]]
    assert re.sub(r"\s+", "", html.extract(page, model)) == re.sub(r"\s+", "", "".join(want))
