"""Whole pages written apart from the training set: precision and recall by words, and pages without any holder or name."""

import time
from collections import Counter
from itertools import product

import pytest

from pulsegrid.llm import html_graph

S = [
    "The museum reopened on Friday after a renovation that took almost four years.", "Visitors queued around the block, and some had travelled from neighbouring countries.", "Its director said the new wing doubles the space for modern sculpture.",
    "Tickets cost twelve euros, although children under ten enter free of charge.", "Critics praised the lighting but found the café rather too loud.", "A second phase, still unfunded, would restore the rooftop garden.", "Work began in 2018 and paused twice.", "Nobody was hurt.",
]
BODIES = {
    "paragraphs": (f"<p>{S[0]} {S[1]}</p><p>{S[2]}</p>", f"{S[0]} {S[1]} {S[2]}"),
    "headed": (f"<h1>Museum reopens</h1><p>{S[0]}</p><h2>Prices</h2><p>{S[3]}</p><p>{S[7]}</p>", f"Museum reopens {S[0]} Prices {S[3]} {S[7]}"),
    "list": (f"<p>{S[0]}</p><ul><li>{S[3]}</li><li>{S[4]}</li><li>Closed on Mondays</li></ul><p>{S[5]}</p>", f"{S[0]} {S[3]} {S[4]} Closed on Mondays {S[5]}"),
    "links": (f"<p>{S[1]} <a href='/d'>The director</a> spoke. {S[2]}</p><blockquote>{S[5]}</blockquote>", f"{S[1]} The director spoke. {S[2]} {S[5]}"),
    "long": (f"<p>{' '.join(S)}</p>" * 3, " ".join([*S, *S, *S])),
    "table": (f"<h2>Hours</h2><p>{S[6]}</p><table><tr><th>Day</th><td>10 to 18</td></tr></table><p>{S[4]}</p>", f"Hours {S[6]} Day 10 to 18 {S[4]}"),
    "loose": (f"{S[0]} {S[1]}<br>{S[2]}", f"{S[0]} {S[1]} {S[2]}"),
}
NAV = "<ul><li><a href='/'>Start</a></li><li><a href='/art'>Art</a></li><li><a href='/shop'>Shop</a></li></ul>"
LAYOUTS = {
    "bare": "<html><body>{}</body></html>",
    "no tags around": "{}",
    "div": "<html><body><div>{}</div></body></html>",
    "two divs": "<!doctype html><html><head><title>M</title></head><body><div><div>{}</div></div></body></html>",
    "semantic": "<body><header><a href='/'>City Paper</a></header><nav>" + NAV + "</nav><main><article>{}</article></main><aside><h3>Most read</h3>" + NAV + "</aside><footer>City Paper, Harbour Street 4</footer></body>",
    "named": "<body><div id='masthead' class='site-header'>" + NAV + "</div><div class='post-content'>{}</div><div class='sidebar-right'><h4>Events</h4><p>Jazz night on Sunday.</p></div><div id='site-footer'><p>Imprint</p></div></body>",
    "comments": "<body><div class='article-body'>{}</div><div id='comments'><h3>2 comments</h3><div class='comment'><p>I went there and loved it.</p></div><div class='comment'><p>Far too expensive for families.</p></div></div></body>",
    "cookie": "<body><div class='cc-window'>We use cookies to improve your visit. <button>Accept</button></div><main>{}</main></body>",
    "newsletter": "<body><article>{}</article><form class='signup'><p>Subscribe to our newsletter</p><input type='email'><button>Go</button></form></body>",
    "bare menu": "<body>" + NAV + "<div>{}</div></body>",
    "hidden": "<body><div hidden><p>Loading the player, please wait a moment.</p></div><article>{}</article></body>",
    "advert": "<body><div class='ad-banner'>Fly to Rome from 39 euros.</div><div class='entry'>{}</div><div class='ad'>Cheap loans today</div></body>",
}


def score(got: str, want: str) -> tuple[int, int, int]:
    a, b = Counter(got.split()), Counter(want.split())
    return (a & b).total(), a.total(), b.total()


#: Layouts written after the weights had been chosen, which never steered them.
HELD = {
    "theme": "<body class='home blog'><div id='wrapper'><div class='branding'><a href='/'>Kiosk</a></div><div id='primary' class='content-area'><div class='hentry'>{}</div></div><div id='secondary' class='widget-area'><h3>Archive</h3>" + NAV + "</div></div></body>",
    "sections": "<body><header><nav>" + NAV + "</nav></header><section>{}</section><section class='related'><h3>Related</h3>" + NAV + "</section><footer><p>Kiosk 2021</p></footer></body>",
    "centre": "<html><body bgcolor=white><center>{}</center></body></html>",
    "layout table": "<body><table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td>{}</td></tr></table></body>",
    "font": "<body><font face=serif>{}</font></body>",
    "paywall": "<body><article><div class='story-body'>{}</div></article><div class='newsletter-signup'><p>Get our letter each morning.</p><form><input><button>Sign up</button></form></div></body>",
    "social": "<body><main id=content>{}<div class='social-share'><a href=f>Share</a> <a href=t>Post</a></div></main></body>",
    "two frames": "<body><div class='header-bar'><p>Kiosk, the weekly</p></div><div><div>{}</div></div><div class='footer'><p>All rights reserved</p></div></body>",
    "replies": "<body><div class='thread'><div class='post'>{}</div></div><ul class='replies'><li><p>Well said, I will go.</p></li><li><p>No thanks.</p></li></ul></body>",
}


def test_held_layouts():
    rows = {(k, b): score(html_graph.main_text(page.format(body)), text) for (k, page), (b, (body, text)) in product(HELD.items(), BODIES.items())}
    hit, got, want = (sum(c) for c in zip(*rows.values(), strict=True))
    assert len(rows) >= 60
    assert hit / got >= 0.95 and hit / want >= 0.95, (hit / got, hit / want, [k for k, (h, g, w) in rows.items() if h < w or h < g])


def test_precision_and_recall_by_words():
    rows = {(k, b): score(html_graph.main_text(page.format(body)), text) for (k, page), (b, (body, text)) in product(LAYOUTS.items(), BODIES.items())}
    hit, got, want = (sum(c) for c in zip(*rows.values(), strict=True))
    assert len(rows) >= 60
    assert hit / got >= 0.95 and hit / want >= 0.95, (hit / got, hit / want, [k for k, (h, g, w) in rows.items() if h < w or h < g])


@pytest.mark.parametrize("layout", ["bare", "no tags around", "div", "two divs", "bare menu"])
@pytest.mark.parametrize("body", BODIES)
def test_pages_without_names_are_whole(layout, body):
    html, text = BODIES[body]
    assert html_graph.main_text(LAYOUTS[layout].format(html)) == text


def test_long_and_short_paragraphs_in_a_bare_div():
    for page in ("<html><body><div><p>{}</p><p>{}</p></div></body></html>", "<html><body><div><p>{}</p><p>{}</p></div><div class=sidebar><p>More news</p></div></body></html>"):
        assert html_graph.main_text(page.format(" ".join(S), S[7])) == f"{' '.join(S)} {S[7]}"


def test_many_open_tags_and_stray_end_tags():
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        html_graph.parse("<div>" * n + "</p></section>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2
