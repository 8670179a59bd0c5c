from __future__ import annotations

import math
import random

import pytest
from lexigrove.llm import html

PAGE = """<!DOCTYPE html><html><head><title>Head &amp; title</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">one link</a><li><a href="/b">another link</a><li><a href='/c>d'>third</a></ul></nav><!-- <p>comment</p> -->
<div class="ad">Short ad.</div><article><h1>A title</h1>{}</article><footer>&copy; foot</footer></body></html>"""
PARAGRAPHS = [f"Paragraph {i} has quite a few words of text, so that it weighs something &amp; more than that." for i in range(5)]


def test_article_is_found():
    body = "<p><b>" + "<br>".join(PARAGRAPHS[:2]) + "<p>" + "</p><p>".join(PARAGRAPHS[2:])
    found = html.extract(PAGE.format(body))
    assert found.path == "html/body/article"
    assert found.text.split("\n") == ["A title"] + [p.replace("&amp;", "&") for p in PARAGRAPHS]


def brute(page):
    """Characters, tags, and links of each node by walking its subtree anew; sums and the best by definition."""
    n = len(page.tags)
    children = {i: [j for j in range(n) if page.parents[j] == i] for i in range(n)}

    def below(i):
        return [i] + [k for j in children[i] for k in below(j)]

    def linked(i):
        while i > 0:
            if page.tags[i] in html.LINKS:
                return True
            i = page.parents[i]
        return False

    def chars(i, links):
        return sum(len(" ".join(s.split())) for o, s in zip(page.owners, page.segments, strict=True) if o in below(i) and (not links or linked(o)))

    ratio = chars(page.body, True) / max(chars(page.body, False), 1)
    value = []
    for i in range(n):
        c, lc = chars(i, False), chars(i, True)
        t, lt = len(below(i)) - 1, sum(page.tags[k] in html.LINKS for k in below(i)[1:])
        if not c:
            value.append(0.0)
            continue
        base = math.log(math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
        plain = c / max(t, 1)
        value.append(plain * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / base if base > 0 else plain)
    return value, [sum(value[j] for j in children[i]) for i in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_densities_against_definition(seed):
    r = random.Random(seed)
    parts = []
    for _ in range(40):
        parts.append(r.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<br>", "<td>", "<table>", "</table>", "some words here ", "x", " \n ", "<!-- c -->", "<", "&lt;"]))
    source = ("<body>" if seed % 2 else "") + "".join(parts)
    page = html.parse(source)
    value, sums = html.densities(page)
    want, want_sums = brute(page)
    assert value == pytest.approx(want) and sums == pytest.approx(want_sums)
    assert all(0 <= page.parents[i] < i for i in range(1, len(page.tags)))
    found = html.extract(source)
    inside = [i for i in range(len(page.tags)) if i >= page.body]
    assert found.density_sum == pytest.approx(max(sums[i] for i in inside), abs=1e-5)


def test_repairs():
    page = html.parse("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><p>f<div>g</div><dl><dt>h<dd>i</dl>")
    ways = {}
    for owner, segment in zip(page.owners, page.segments, strict=True):
        way, at = [], owner
        while at > 0:
            way.append(page.tags[at])
            at = page.parents[at]
        if segment.strip():
            ways[segment] = "/".join(reversed(way))
    assert ways == {"a": "ul/li", "b": "ul/li", "c": "table/tr/td", "d": "table/tr/td", "e": "table/tr/td", "f": "p", "g": "div", "h": "dl/dt", "i": "dl/dd"}


@pytest.mark.parametrize("source,text", [("", ""), ("plain text", "plain text"), ("<body></body>", ""), ("<p", "<p"), ("<script>x", ""), ("a < b and c > d", "a < b and c > d"), ("<!-- never ends", ""), ("<body>only body text", "only body text")])
def test_odd_pages(source, text):
    assert html.extract(source).text == text


def test_quadratic_cases_end():
    for source in ("<" * 50_000, "<a " * 20_000, "<div>" * 50_000 + "x", "<p><b>" * 20_000 + "x", "<ul><li>" * 20_000 + "</li>" * 20_000, "<div>" * 20_000 + "</p></div>" * 20_000, "<!--" * 20_000, "</p>" * 20_000, '<a b="' * 5_000):
        html.extract(source)


def test_rows(spark):
    rows = [(1, "u", PAGE.format("<p>" + "</p><p>".join(PARAGRAPHS) + "</p>"), "t", 1), (2, "u", None, "t", 1), (None, "u", "x", "t", 1), (1, "u", "", "t", 1), (3, None, "word " * 300_000, "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = sorted(map(tuple, html.extract_pages(df).select("page_id", "n_chars").collect()), key=str)
    assert len(out) == 5 and (2, None) in out and (1, 0) in out and (None, 1) in out and (3, 1_499_999) in out
    assert html.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_text_against_definition(seed):
    """What reaches the threshold, down from the body, adds the best subtree that it holds; the text is that of all these, in order."""
    r = random.Random(100 + seed)
    source = "<body>" + "".join(r.choice(["<div>", "<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", f"words {i} of text here ", "more text than that, quite a lot of it ", "<br>"]) for i in range(50))
    page = html.parse(source)
    value, sums = brute(page)
    n = len(page.tags)
    below = {i: {i} for i in range(n)}
    for i in range(n - 1, 0, -1):
        below[page.parents[i]] |= below[i]
    best = max(sorted(below[page.body]), key=lambda i: (round(sums[i], 9), -i))
    way = [best]
    while way[-1] != page.body:
        way.append(page.parents[way[-1]])
    threshold = min(value[i] for i in way)
    chosen = {best}

    def visit(i):
        top = max(sorted(below[i]), key=lambda k: (round(sums[k], 9), -k))
        if value[i] >= threshold - 1e-12 and sums[top] > 0:
            chosen.add(top)
            for j in range(n):
                if page.parents[j] == i:
                    visit(j)

    visit(page.body)
    inside = set().union(*(below[i] for i in chosen))
    parts = "".join(s for o, s in zip(page.owners, page.segments, strict=True) if o in inside)
    lines = [" ".join(x.split()) for x in parts.split("\n")]
    assert html.extract(source).text == "\n".join(x for x in lines if x)
