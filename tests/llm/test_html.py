"""HTML text: long numbers, odd tags in linear time, spans, awkward tables."""

import time

import pytest

from staylens.llm import html_text

text = html_text.page_text


@pytest.mark.parametrize("piece", [
    '<a "', "<a '", '<a b="', "<a ", "<!", "<!--", "</script", "<div>", "<p>", "</span>", "<div><p></b>",
    "<p><table><td><div>", "<ul><li>", "<table><tr><td>", "<script>", "<svg><g>", "<a x=' y=\"",
    "<select><option>", "<td rowspan=9>", "&amp;", "< "])
def test_odd_pages_take_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        text(piece * (n // len(piece)))
        return time.process_time() - start

    seconds(1000)
    assert seconds(200_000) < 12 * max(seconds(50_000), 0.05)


def test_long_numbers():
    digits = "9" * 5000
    assert text(f"<table><tr><td colspan={digits}>a<td rowspan={digits}>b<tr><td>c</table>") == "a  b\nc"
    assert text(f"<ol start={digits}><li>a</ol>") == "1. a"
    assert text(f"<ol start=007><li>a<li>b</ol>") == "7. a\n8. b"
    assert text(f"<select size={digits}><option>a<option>b</select>") == "a\nb"
    assert text("<table><tr><td colspan=x rowspan=-1>a<td colspan=\u0663>b</table>") == "a  b"


def test_rows_that_reach_down():
    page = "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>"
    assert text(page) == "a  b\n   c\nd  e"
    page = "<table><tr><td>x<td rowspan=3 colspan=2>y<td>z<tr><td>k<td>l<tr><td>m</table>"
    assert text(page) == "x  y  z\nk     l\nm"


def test_quotes_count_where_values_begin():
    assert text("<p title=it's>a</p><p>it's b</p>") == "a\n\nit's b"
    assert text("<img alt='a > b'><b x=\"1>2\">c</b>") == "a > bc"
    assert text("<p \"odd\">a <i / >b</i> <br/>c") == "a b\nc"
    assert text("a <b c=\"never closed <i>d") == "a"
    assert text("1 < 2 <3 </4> <?x y?>z") == "1 < 2 <3 </4> z"


def test_awkward_pages(spark):
    rows = [(1, "u", None, "t", 1), (1, None, "", "t", 1), (None, "u", "<p>x" * 20_000, None, None),
            (2, "u", "<p>a", "t", 2), (2, "u", "<p>a", "t", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["n_chars"], r["n_lines"]) for r in
                  html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 0, 0), (None, 59_998, 39_999), (2, 1, 1), (2, 1, 1)], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0
