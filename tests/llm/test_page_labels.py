"""data-y on pages to be extracted: an attribute like any other."""

import pytest

from pulsegrid.llm import html_graph

PART = "<p>The article tells at some length what happened at the river, and who was there to see it happen.</p>"


@pytest.mark.parametrize("value", ["12.5", "", "top", "0", "1", "7"])
def test_pages_with_data_y(value):
    page = f"<body><nav><a href=/>Home</a></nav><article X><div X>{PART}{PART}</div><svg X><g X></g></svg></article></body>"
    assert html_graph.main_text(page.replace("X", f'data-y="{value}"')) == html_graph.main_text(page.replace(" X", ""))


def test_labels_are_read_to_fit():
    page = "<body data-y=2><div data-y=1>a</div></body>"
    assert [x.label for x in html_graph.parse(page, labels=True)] == [None, 2, 1, None]
    assert all(x.label is None for x in html_graph.parse(page))


def test_extract_keeps_all_pages(spark):
    rows = [(1, "u", f"<article>{PART}</article>"), (2, "u", f"<article><div data-y='12.5'>{PART}</div></article>")]
    got = html_graph.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 2 and all("The article" in r.text for r in got)
