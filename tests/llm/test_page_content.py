"""Pages written apart from those of the training set: what stays and what goes."""

import re
from itertools import product

import numpy as np
import pytest

from pulsegrid.llm import html_graph

A = "Engineers inspected the dam on Monday and found two hairline cracks near the spillway."
B = "They expect repairs to take six weeks, weather permitting, and to cost less than planned."


@pytest.mark.parametrize("name", ["header-image", "ad-free", "header-image ad-free", "sidebar-free", "comment-free text", "menu-card text", "footer-free image"])
def test_names_that_only_sound_like_frames(name):
    page = f"<body><nav><a href=/>Start</a></nav><article><h1>Dam</h1><p>{A}</p><div class='{name}'><p>{B}</p></div></article><footer>c</footer></body>"
    assert html_graph.main_text(page) == f"Dam {A} {B}"


@pytest.mark.parametrize("part", ["<object>W</object>", "<p>W</p>", "<video>W</video>", "<p><math><mi>W</mi></math></p>", "<table><tr><td>W</td></tr></table>", "<svg><text>W</text></svg>", "<canvas>W</canvas>", "<p><button>W</button></p>"])
def test_no_element_of_an_article_goes_by_rule(part):
    words = "the words in here"
    assert html_graph.main_text(f"<body><article><p>{A}</p>{part.replace('W', words)}<p>{B}</p></article></body>") == f"{A} {words} {B}"


@pytest.mark.parametrize(
    "frame",
    ["<div class=ad>W</div>", "<div class='ad-wrapper'><p>W</p></div>", "<section id=comments><p>W</p></section>", "<form><p>W</p><button>Go</button></form>", "<aside><p>W</p></aside>", "<div class=sidebar><p>W</p></div>",
     "<div class='cookie-notice'>W</div>", "<script>W</script>", "<style>W</style>", "<nav><a href=/x>W</a></nav>", "<template>W</template>", "<div class=newsletter><p>W</p></div>"],
)
def test_frames_inside_an_article_go(frame):
    words = "Order the fine kettle today and save."
    page = f"<body><article><h1>Dam</h1><p>{A}</p>{frame.replace('W', words)}<p>{B}</p></article></body>"
    assert html_graph.main_text(page) == f"Dam {A} {B}"


def test_a_page_of_many_parts():
    page = f"""<!doctype html><html><head><title>Dam</title></head><body class=home><div id=top class=navbar><a href=/>Home</a> <a href=/n>News</a></div>
    <div id=layout><main><h1>Dam</h1><p>{A}</p><h2>Cost</h2><p>{B}</p><ul><li>Six weeks</li><li>{A}</li></ul></main>
    <div class=sidebar><h3>Latest</h3><p>Rain is likely.</p></div></div><div class=comments><div class=comment><p>I saw it too, it was bad.</p></div></div><div id=footer>&copy; 2020</div></body></html>"""
    assert html_graph.main_text(page) == f"Dam {A} Cost {B} Six weeks {A}"


def test_extraction_equals_enumeration():
    """Blocks whose content probability, summed over all states of all nodes, is at least a half."""
    model = html_graph.trained()
    for page in (f"<body><article><p>{A}</p></article><div class=ad>{B}</div></body>", f"<body><div><p>{A}</p><aside>{B}</aside></div></body>", f"<nav><a>x</a></nav>{A}<p>{B}"):
        nodes = html_graph.parse(page)
        own = [sum((np.array(model.node.get(f, (0.0,) * 3)) for f in html_graph.features(x, nodes[x.parent] if k else None)), np.zeros(3)) for k, x in enumerate(nodes)]
        mass = np.zeros((len(nodes), 3))
        for states in product(range(3), repeat=len(nodes)):
            w = sum(own[k][s] for k, s in enumerate(states)) + sum(model.edge[html_graph.kind(nodes[k])][states[nodes[k].parent]][states[k]] for k in range(1, len(nodes)))
            mass[np.arange(len(nodes)), states] += np.exp(w)
        share = mass[:, html_graph.CONTENT] / mass.sum(axis=1)
        want = " ".join(re.sub(r"\s+", " ", "".join(x.text)).strip() for x, p in zip(nodes, share, strict=True) if x.tag == "#text" and p >= 0.5)
        assert html_graph.main_text(page) == want
