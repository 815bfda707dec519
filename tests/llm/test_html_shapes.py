"""Pages whose shape used to cost time or text."""

import time

import pytest

from voltaflow.llm import html_extract


def texts(page):
    return [t for _, t, _ in html_extract.blocks_of(page)]


def test_comments_end_as_browsers_end_them():
    assert texts("<p>a<!-- x --!> b</p><p>c<!--> d</p><p>e<!---> f<!-- --> g<!-- <p>--</p> --> h</p><p>i<!-- never ended <p>j") == ["a b", "c d", "e f g h", "i"]


@pytest.mark.parametrize("shape", [("<i>x", "<li>y", ""), ("<b><div>", "", "</b>"), ("<i>", "</b>", ""), ("<svg><b><div><i>", "</b>", ""), ("<p>x<section>", "<p>y", ""), ("<td>x<table>", "<td>y", "")])
def test_time_grows_with_the_page(shape):
    def took(n):
        start = time.perf_counter()
        html_extract.blocks_of("".join(part * n for part in shape))
        return time.perf_counter() - start

    small, large = (min(took(n) for _ in range(2)) for n in (2000, 8000))
    assert large < 0.5 or large < 9 * small


def test_ends_and_siblings():
    assert texts("<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>f") == ["a", "b", "c", "d", "e", "f"]
    assert texts("<p>a<div>b</p>c</div>d") == ["a", "b", "c", "d"]
    assert texts("<b>a<div>b</b>c</div>d") == ["a", "bc", "d"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<head><title>t</title><body><p>x") == ["x"]
