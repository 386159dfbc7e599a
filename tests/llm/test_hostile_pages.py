"""Broken, nested and unclosed pages take time in proportion to their length."""

from __future__ import annotations

import time

import numpy as np
import pytest

from corpusloom.llm import html_extract

SHAPES = {
    "unclosed": lambda n: "<a " * n,
    "unclosed quote": lambda n: '<a "' * n,
    "unpaired quote": lambda n: '<a x=">' * (2 * n + 1) + "'",
    "nested": lambda n: "<div>" * n,
    "mismatched": lambda n: "<div><b>" * n + "</i>" * n,
    "behind a wall": lambda n: "<b><div>" + "<i>" * n + "</b>" * n,
    "paragraphs in buttons": lambda n: "<p><button>" * n,
    "tables": lambda n: "<table><tr><td>" * n,
    "unclosed script": lambda n: "<script>" + "</script " * n,
    "unclosed comments": lambda n: "<!-" * n + "<!--" * n,
}


def seconds(source):
    best = float("inf")
    for _ in range(3):
        start = time.process_time()
        page = html_extract.Page(source)
        html_extract.features(page)
        best = min(best, time.process_time() - start)
    return best


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_time_in_proportion(shape):
    small, large = seconds(SHAPES[shape](2500)), seconds(SHAPES[shape](20_000))
    assert large < 0.05 + 24 * small  # eight times the length


def test_what_broken_pages_say():
    text = lambda h: [t for t in html_extract.Page(h).texts if t]
    assert text("one <!-- two > three") == ["one"]
    assert text("one <![CDATA[two > three") == ["one two > three"]
    assert text("a < b and c <d") == ["a < b and c <d"]
    assert text("<b>one</i> two</b> three") == ["one two three"]
    assert text("<p>one<p>two</div>") == ["one", "two"]
    assert text("<script>x</script") == []


def test_unpaired_quotes_leave_later_tags_alone():
    page = html_extract.Page('<p title="a>one</p>' + "<p>two</p>" * 20)
    assert page.texts.count("two") == 20
    assert np.isfinite(html_extract.features(page)).all()
