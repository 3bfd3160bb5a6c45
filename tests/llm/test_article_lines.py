"""Operator 1 inside articles, in forms around the page and in boxes named by their place."""

import random

import pytest

from lexiloom.llm import html


def text(page):
    lines = html.lines_of(page)
    main = html.main_zone("".join(z for z, _ in lines))
    return [t for z, t in lines if z == main]


LONG = "a paragraph of some length that says what the page is about"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="left-side"><p>{LONG}<p>{LONG} too</div><div class="meta">By Ann</div>', [LONG, f"{LONG} too", "By Ann"]),
        ('<article><p class="share">The share rose.<p class="ad">x<p>two</article>', ["The share rose.", "two"]),
        ('<p class="share">The share rose.<p>two', ["The share rose.", "two"]),
        (f'<p>{LONG}<ul class="bottom-list"><li>one<li>two</ul>', [LONG, "one", "two"]),
        (f'<form id="aspnetForm"><div>{LONG}</div><p>two</form><p>out', [LONG, "two", "out"]),
        (f'<form id="aspnetForm"><article><p>{LONG}</article></form><p>out', [LONG]),
        (f'<p>{LONG}<form>Your name</form>', [LONG]),
        (f'<article><p>{LONG}<form>Your name</form></article>', [LONG]),
        (f'<p>{LONG}<div class="side">x</div><div class="sidebar">{LONG} and more of it</div>', [LONG]),
        (f'<div class="banner">x</div><div class="comments">{LONG}</div><p>one', ["one"]),
    ],
)
def test_text_of_boxes(page, want):
    assert text(page) == want


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n)) + str(rng.random())


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<form id=aspnetForm>{}</form>", "<div class='side'>{}</div>", "{}"])
def test_neighbours_decide_inside_articles(spark, wrap):
    """Lines of all pages go, in articles too; an article's quotations, which some of the pages share, stay."""
    rng = random.Random(8)
    site, quotes = [words(rng, 4) for _ in range(3)], [words(rng, 20) for _ in range(4)]
    rows, want = [], []
    for k in range(60):
        own = [words(rng, 30) for _ in range(rng.randint(1, 4))]
        if "article" in wrap and k % 9 == 4:  # no two of these are neighbours
            own.insert(1, quotes[k % 4])
        body = "".join(f"<p>{x}</p>" for x in [site[0], *own, *site[1:]])
        rows.append((k, f"http://a.com/p{k:03d}", wrap.format(body), "z"))
        want.append(own)
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, z string")).collect()}
    for k, own in enumerate(want):
        near = sum(0 <= k + d < 60 for d in (-4, -2, -1, 1, 2, 4))
        kept = [site[0], *own, *site[1:]] if near < html.MOST and "article" in wrap else own
        assert got[k].text.split("\n") == kept, k
        assert got[k].n_only_struck_lines == (0 if kept is not own else 3)


def test_a_quotation_that_some_neighbours_share_stays(spark):
    rng = random.Random(9)
    quote = words(rng, 20)
    rows = [(k, f"http://q.com/{k:03d}", f"<article><p>{words(rng, 30)}</p>" + (f"<p>{quote}</p>" if k % 3 else "") + "</article>") for k in range(40)]
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all((quote in t) == bool(k % 3) for k, t in got.items())
