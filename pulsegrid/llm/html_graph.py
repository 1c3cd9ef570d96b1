"""HTML extraction: a tree-structured graphical model over the DOM, with sum-product messages."""

from __future__ import annotations

import functools
import html as html_lib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Elements of HTML, by how they are read (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: What holds no text of the page.  All else is for the model to tell.
DROPPED = frozenset("script style title textarea iframe noembed noframes template head".split())
#: Elements that a start tag of the key closes, up to the nearest of the elements that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
#: Words of notices, forms and page ends, in the languages of the training pages (fixed values).
NOTICE_WORDS = frozenset("accept advertisement browser consent cookie cookies copyright newsletter policy privacy reserved rights settings sponsored subscribe subscription terms unsubscribe".split())
_LETTERS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    label: int | None = None
    text: list[str] = field(default_factory=list)  # of a text block
    size: int = 0  # characters of text in it and below
    linked: int = 0  # of these, those in links


def parse(source: str, labels: bool = False) -> list[Node]:
    """The block elements and text blocks of a page, parents before children.

    Inline elements belong to the text block around them.  Tags that are never closed, closed
    twice or out of order are tolerated; comments and elements without text of the page go.
    ``labels``: data-y is the state of an element; else it is an attribute like any other.
    """
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # tag, its node (that of the block around, for inline tags)
    block: Node | None = None
    open_ = Counter()  # by tag, so that an end tag without a start tag costs nothing
    links = dropped = 0
    at, n = 0, len(source)

    def say(text: str) -> None:
        nonlocal block
        if dropped or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Node("#text", stack[-1][1])
            nodes.append(block)
        text = html_lib.unescape(text) if "&" in text else text
        block.text.append(text)
        shown = len(text) - text.count(" ")
        block.size += shown
        if links:
            block.linked += shown

    def pop() -> None:
        nonlocal block, links, dropped
        tag, _ = stack.pop()
        open_[tag] -= 1
        links -= tag == "a"
        dropped -= tag in DROPPED
        if tag not in INLINE:
            block = None

    def close(tags: set[str], bounds: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in bounds:
                return

    while at < n:
        i = source.find("<", at)
        if i < 0:
            say(source[at:])
            break
        if i > at:
            say(source[at:i])
        if source.startswith("<!--", i):
            j = source.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        if source.startswith(("<!", "<?"), i):
            j = source.find(">", i)
            at = n if j < 0 else j + 1
            continue
        m = _TAG.match(source, i) or _LOOSE.match(source, i)
        if m is None:
            if source[i + 1 : i + 2].isalpha() or source.startswith("</", i):
                at = n if source.find(">", i) < 0 else source.find(">", i) + 1
            else:
                say("<")
                at = i + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                say(" ")
            elif open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in ("br", "wbr"):
            say(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        if tag not in INLINE:
            block = None
            if tag in CLOSES:
                close(*CLOSES[tag])
            elif tag not in DROPPED:
                close({"p"}, {"td", "th", "li", "article", "section", "div", "body", "table"})
            if tag == "body":
                close({"head"}, set())
            node = Node(tag, stack[-1][1])
            if _HIDDEN.search(m[3]):
                node.names.append("hidden")
            for name, *value in _NAMES.findall(m[3]):
                value = "".join(value)
                if name.lower() == "data-y":
                    node.label = int(value) if labels else None
                else:
                    for token in value.split():
                        node.names.append(f"token={token.lower()}")
                        node.names += [f"part={w.lower()}" for w in _WORDS.findall(token)]
            nodes.append(node)
            here = len(nodes) - 1
        else:
            here = stack[-1][1]
            links += tag == "a"
        dropped += tag in DROPPED
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            j = n if end is None else source.find(">", end.end())
            at = n if j < 0 or end is None else j + 1
            dropped -= tag in DROPPED
        elif not m[3].endswith("/") or tag not in ("path", "circle"):
            stack.append((tag, here))
            open_[tag] += 1
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].size += nodes[k].size
        nodes[nodes[k].parent].linked += nodes[k].linked
    return nodes


def shares(node: Node) -> int:
    """How much of the text is in links: little, some, most."""
    share = node.linked / max(1, node.size)
    return 0 if share < 0.1 else 1 if share < 0.6 else 2


def features(node: Node, parent: Node | None) -> list[str]:
    if node.tag != "#text":
        above = f"{parent.tag}{'*' if parent.names else ''}" if parent else ""
        filled = [f"linked={shares(node)}", f"size={min(12, node.size.bit_length())}"] if node.size else ["linked=none"]
        return [f"tag={node.tag}", f"path={above}>{node.tag}", *filled, *dict.fromkeys(node.names)]
    text = " ".join("".join(node.text).split())
    words = text.count(" ") + 1
    return [
        f"in={parent.tag if parent else ''}",
        f"words={min(6, words.bit_length())}",
        f"links={shares(node)}",
        f"end={text[-1:] in '.!?…:;'}",
        f"notice={min(2, len(NOTICE_WORDS.intersection(_LETTERS.findall(text[:NOTICE_CHARS].lower()))))}" if words < 60 else "notice=0",
    ]


#: Longer blocks are no notices, so their words are not looked at.
NOTICE_CHARS = 1000
#: Features of a node say much the same in part, so each kind of feature counts for a part of its evidence.
#: Chosen by the errors on the training pages and on pages like those of tests/llm/test_independent_pages.py.
WEIGHTS = {"in": 0.1, "words": 0.15, "links": 1.0, "end": 0.25, "notice": 1.2, "tag": 0.6, "path": 1.0, "linked": 1.0, "size": 0.45, "part": 0.9, "token": 1.3}
#: How much of its overall rate a feature keeps in states where it was not seen.
SMOOTH = 0.01
#: States of a node: the rest of a page, its content, and a frame that holds both.
REST, CONTENT, FRAME = STATES = (0, 1, 2)


@dataclass
class Model:
    """Log potentials: of a state given features, and of parent and child states."""

    node: dict[str, tuple[float, ...]]
    edge: dict[str, list[list[float]]]  # by kind of child: [parent][child]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content for each node, exact on the tree: one pass up, one down."""
        n = len(nodes)
        own, up, down = ([[0.0] * len(STATES) for _ in nodes] for _ in range(3))
        for k, x in enumerate(nodes):
            mine = own[k]
            for f in features(x, nodes[x.parent] if x.parent >= 0 else None):
                if f in self.node:
                    for y, v in enumerate(self.node[f]):
                        mine[y] += v
        for k in range(n - 1, 0, -1):
            e, mine, above = self.edge[kind(nodes[k])], own[k], own[nodes[k].parent]
            for y in STATES:
                up[k][y] = _sum([a + b for a, b in zip(e[y], mine, strict=True)])
                above[y] += up[k][y]
        out = [0.0] * n
        for k in range(n):
            if k:
                e, p = self.edge[kind(nodes[k])], nodes[k].parent
                rest = [own[p][y] + down[p][y] - up[k][y] for y in STATES]
                down[k] = [_sum([rest[y] + e[y][z] for y in STATES]) for z in STATES]
            both = [a + b for a, b in zip(own[k], down[k], strict=True)]
            out[k] = math.exp(both[CONTENT] - _sum(both))
        return out


def _sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def kind(node: Node) -> str:
    return "text" if node.tag == "#text" else "element"


def fit(pages: list[str]) -> Model:
    """Smoothed rates from pages whose elements carry data-y, a state; others take that of their parent.

    Text directly in a frame is content.
    """
    seen, total, edges = Counter(), Counter(), Counter()
    for page in pages:
        nodes = parse(page, labels=True)
        for k, x in enumerate(nodes):
            p = nodes[x.parent] if k else None
            if x.label is None:
                x.label = FRAME if p is None else CONTENT if p.label == FRAME and x.tag == "#text" else p.label
            total[kind(x), x.label] += 1
            if p:
                edges[kind(x), p.label, x.label] += 1
            for f in set(features(x, p)):
                seen[f, x.label] += 1
    node = {}
    for f in {f for f, _ in seen}:
        group = f.split("=")[0]
        k, weight = "text" if group in ("in", "words", "links", "end", "notice") else "element", WEIGHTS.get(group, 1.0)
        often = sum(seen[f, y] for y in STATES) / sum(total[k, y] for y in STATES)
        # smoothed in proportion to how common the feature is, so that it says nothing between states without it
        node[f] = tuple(weight * math.log(seen[f, y] / max(1, total[k, y]) + SMOOTH * often) for y in STATES)
    rows = {(k, p): sum(edges[k, p, y] for y in STATES) for k in ("element", "text") for p in STATES}
    edge = {k: [[math.log((edges[k, p, y] + 0.3) / (rows[k, p] + 0.9)) for y in STATES] for p in STATES] for k in ("element", "text")}
    return Model(node, edge)


def labelled_pages() -> list[str]:
    """Pages written for training: every kind of frame with every kind of body.  data-y marks content and rest."""
    long = "The river rose for three days before it reached the old bridge, and people came from far to see it."
    said = "I do not agree with what was written here, since the facts are quite different in our town."
    body = [
        f"<h1>{long[:40]}</h1><p>{long} {long}</p><p>{long}</p><p>Yes.</p>",
        f"<h1>Floods</h1><h2>A short word</h2><p>{long} <a href=x>bridge</a> {long}</p><ul><li>one thing</li><li>{long}</li></ul>",
        f"<h2>{long[:60]}</h2><p><b>{long}<br><p>{long * 3}</p><blockquote>{long}</blockquote><pre>x = 1</pre>",
        f"<h1>It</h1><p>No. 3 | b | c | d</p><p>{long[:20]}</p><table><tr><td>12</td><td>{long}</td></tr></table>",
        f"<p>{long * 6}</p><figure><figcaption>The bridge</figcaption></figure><p>Then it fell.</p>",
        f"<div><p>{long}</p></div><section><h3>Later</h3><p>{long * 2}</p><ol><li>a</li><li>b c d</li></ol></section>",
        f"{long} {long}",
        f"<p>{long}</p><ul><li>{long}</li><li>{long[:9]}</li><li>{long[:20]}</li></ul><p>{long}</p><ol><li>{long[:30]}</li><li>{long}</li><li>two days</li></ol>",
        f"<h2>List</h2><ul><li>a cup</li><li>two spoons</li><li>{long}</li><li>{long[:40]}</li></ul><p>{long}</p><ul><li>{long}</li></ul>",
    ]
    holders = [
        "<article>{}</article>", "<article class=post>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=content>{}</div>",
        "<div id=main-content>{}</div>", "<section class=post-body>{}</section>", "<div class=entry-content>{}</div>", "<div class=article-body>{}</div>",
        "<div role=main>{}</div>", "<div class=story>{}</div>", "<div class=text>{}</div>",
    ]
    menu = "<ul><li><a href=/a>Home</a></li><li><a href=/b>the,</a></li><li><a href=/c>About us</a></li></ul>"
    line = f"<p>{long[:50]}</p>"
    talk = f"<div class=comment><p>{said} {said}</p></div><p>{said}</p><ul><li><p>{said}</p></li></ul>"
    before = [
        f"<nav data-y=0>{menu}</nav>", f"<header data-y=0 class=site-header><h1>The Site</h1><p>{long[:30]}</p>{menu}</header>", f"<div data-y=0 class=menu>{menu}</div>",
        f"<div data-y=0 class=ad>{long}</div>", f"<div data-y=0 class=advert>{line}</div>", f"<div data-y=0 class='banner promo'>{long}</div>", f"<div data-y=0 class=sponsored>{line}</div>",
        f"<div data-y=0 class=cookie-notice>{long} <button>OK</button></div>", f"<div data-y=0 id=cookie-consent>{line}</div>", f"<div data-y=0 class='notice alert'>{long}</div>",
        f"<div data-y=0 class=breadcrumbs>{menu}</div>", f"<div data-y=0 id=navigation class=navbar>{menu}</div>", f"<div data-y=0 id=header><p>{long[:30]}</p></div>",
        f"<form data-y=0 class=search>Find {long[:20]} <input name=q><select><option>All<option>News</select></form>", f"<div data-y=0 class=topbar role=navigation>{menu}</div>", f"<div data-y=0 role=banner>{line}</div>",
        f"<noscript data-y=0>{long}</noscript>", f"<div data-y=0 class=ad-slot>{long}</div>", f"<div data-y=0 class=page-header>{line}</div>", f"<div data-y=0 class='main-menu menu-list'>{menu}</div>",
    ]
    after = [
        f"<footer data-y=0>&copy; site &middot; {long[:60]}</footer>", f"<footer data-y=0><p>{long}</p>{menu}</footer>", f"<div data-y=0 id=footer class=copyright>{line}</div>",
        f"<aside data-y=0>{line}{menu}</aside>", f"<aside data-y=0 class=sidebar><h3>More</h3><p>{long}</p></aside>", f"<div data-y=0 class='sidebar widget'>{line}{line}</div>",
        f"<section data-y=0 id=comments><h2>Comments</h2>{talk}</section>", f"<div data-y=0 class=comments>{talk}{talk}</div>", f"<ol data-y=0 class=comment-list><li><p>{said}</p></li></ol>",
        f"<div data-y=0 class='related recommended'><h3>Read on</h3>{menu}</div>", f"<div data-y=0 class='share social'>{menu}</div>", f"<div data-y=0 class=disqus id=respond>{talk}</div>",
        f"<form data-y=0 class=newsletter><p>{long}</p><label>Mail</label><input></form>", f"<form data-y=0>{line}<label>Your name</label><button>Send</button></form>", f"<div data-y=0 class=subscribe>{line}</div>",
        f"<div data-y=0 class=replies>{talk}</div>", f"<div data-y=0 role=complementary>{line}</div>", f"<div data-y=0 role=contentinfo>{line}</div>", f"<div data-y=0 class=pagination>{menu}</div>",
        f"<div data-y=0 class='ad-container google-ad'>{line}</div>", f"<div data-y=0 class=footer-links>{menu}</div>", f"<div data-y=0 class=comment-thread>{talk}</div>",
        f"<div data-y=0 class=ad-box>{line}</div>", f"<div data-y=0 class='top-ad'>{long}</div>", f"<div data-y=0 id=ad-unit-1><p>Save now</p></div>",
        f"<div data-y=0 class=footer-wrapper>{line}</div>", f"<div data-y=0 class=nav-container>{menu}</div>", f"<div data-y=0 id=comments-wrapper>{talk}</div>", f"<div data-y=0 class='promo-wrapper'>{line}</div>",
        f"<section data-y=0 id=comments><p>{said}</p></section>", f"<section data-y=0 class=comments>{line}</section>", f"<section data-y=0 class='related-posts'>{line}{menu}</section>", f"<section data-y=0 class=newsletter>{line}</section>",
    ]
    # content whose names share words with what is not
    contrary = [
        "header-image", "ad-free", "image-header", "sidebar-free text", "notice-free", "article-header", "menu-card text", "comment-free", "story-header", "free-text", "image-caption", "text-block", "quote", "key-facts", "image-text ad-free",
        "header-text", "body-text", "story-text share-free", "banner-image", "footer-free image",
    ]
    within = [f"<div class='{{}}'><p>{long}</p></div>", f"<section class='{{}}'><p>{long}</p><p>{long[:40]}</p></section>", f"<figure class='{{}}'><figcaption>{long}</figcaption></figure>", "<div class='{}'><p>It was so.</p></div>"]
    hidden = [f"<div data-y=0 hidden><p>{long}</p></div>", f"<div data-y=0 aria-hidden=true>{line}</div>", f"<p data-y=0 style='display: none'>{long}</p>", f"<section data-y=0 hidden><h2>Later</h2><p>{long}</p></section>"]
    unusual = [
        f"<object><p>{long}</p></object>", f"<p>{long} <button>See the map</button> {long[:30]}</p>", f"<video><p>{long}</p></video>", f"<svg><text>{long[:30]}</text></svg>", f"<details><summary>{long[:30]}</summary><p>{long}</p></details>",
        f"<dl><dt>River</dt><dd>{long}</dd></dl>", f"<canvas>{long}</canvas>", f"<audio>{long[:40]}</audio>",
    ]
    pages = []
    for i in range(480):
        holder = holders[i % len(holders)].replace(">{", " data-y=1>{").format(body[(i // 3) % len(body)])
        frame = before + after
        if i % 3 == 0:
            holder = holder.replace("data-y=1>", "data-y=1>" + frame[(7 * i + 3) % len(frame)], 1)
        if i % 3 == 1:
            holder = holder.replace("</p><", f"</p>{frame[(11 * i + 5) % len(frame)]}<", 1)
        more = within[(i // 2) % len(within)].format(contrary[(i // 5) % len(contrary)]) if i % 4 < 2 else unusual[(i // 4) % len(unusual)] if i % 4 == 2 else ""
        cut = holder.rfind("</")
        holder = holder[:cut] + more + holder[cut:] if cut > 0 else holder
        head, tail = before[i % len(before)] + before[(5 * i + 1) % len(before)], after[i % len(after)] + after[(3 * i + 2) % len(after)]
        if i % 6 == 5:
            head = hidden[i // 6 % len(hidden)] + head
        wrap = ("{}", "<div class=wrapper data-y=2>{}</div>", "<div id=page class=container data-y=2>{}</div>")[i % 3]
        pages.append(f"<html data-y=2><body data-y=2>{wrap.format(head + holder + tail)}</body></html>")
    return pages + plain_pages(body, before, after, menu, said)


def plain_pages(bodies: list[str], before: list[str], after: list[str], menu: str, said: str) -> list[str]:
    """Half as many pages again, without holder, class or frame: text in the body, in bare divs, in tables; some with bare menus and notices.  Some layouts come without a body element too."""
    content = lambda b: re.sub("<(p|h1|h2|h3|div|section|ul|ol|blockquote|pre|table|figure)>", r"<\1 data-y=1>", b)
    layouts = [
        "{body}", "<div data-y=1>{plain}</div>", "<div data-y=2>{body}</div>", "<div data-y=2><div data-y=1>{plain}</div></div>", "{menu}{body}", "<div data-y=2>{menu}<div data-y=1>{plain}</div></div>",
        "{menu}<div data-y=1>{plain}</div>{notice}", "{notice}{body}", "{notice}<div data-y=1>{plain}</div>{menu}", "<table data-y=2><tr><td data-y=0>{menu}</td><td data-y=1>{plain}</td></tr></table>", "{head}{body}{tail}", "{head}<div data-y=1>{plain}</div>{tail}",
    ]
    menus = [f"<div data-y=0>{menu}</div>", menu.replace("<ul>", "<ul data-y=0>"), "<div data-y=0><a href=/a>Home</a> | <a href=/b>News</a> | <a href=/c>Help</a></div>", "<p data-y=0><a href=/a>Home</a> <a href=/b>Back</a></p>"]
    notices = [
        "<div data-y=0>We use cookies on this site. See our privacy policy.</div>", "<div data-y=0><p>This site sets cookies. By staying you accept our terms.</p><button>Accept</button></div>", "<div data-y=0>Copyright 2019. All rights reserved.</div>",
        "<p data-y=0>Copyright, all rights reserved, privacy policy.</p>", "<div data-y=0><p>Subscribe to our newsletter.</p><button>Subscribe</button></div>", "<div data-y=0 class=x><p>Your browser settings block cookies. Accept them?</p></div>",
    ]
    out = []
    for i in range(240):
        body = bodies[(i // len(layouts)) % len(bodies)]
        parts = {"plain": body, "body": content(body), "menu": menus[i % len(menus)], "notice": notices[(i // 2) % len(notices)], "head": before[(7 * i) % len(before)], "tail": after[(5 * i) % len(after)]}
        page = layouts[(i + i // len(layouts)) % len(layouts)].format(**parts)
        out.append(page if i % 3 == 2 else f"<html data-y=2><body data-y=2>{page}</body></html>")
    return out


@functools.cache
def trained() -> Model:
    return fit(labelled_pages())


def main_text(source: str, model: Model | None = None) -> str:
    """The main text of a page: content blocks in page order, white space inside a block one space, one space between blocks."""
    nodes = parse(source)
    chance = (model or trained()).marginals(nodes)
    blocks = (" ".join("".join(x.text).split()) for x, p in zip(nodes, chance, strict=True) if x.tag == "#text" and p >= 0.5)
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html), from the whole html.

    Null html is empty, and a page without content gets an empty text.  Each page is
    handled on its own, so ties and repeated rows make no difference; an empty table
    gives an empty result.
    """
    arrow_batches(pages.sparkSession, 200)
    model = trained()

    def run(batches):
        for b in batches:
            text = [main_text(s, model) for s in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
