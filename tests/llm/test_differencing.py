"""Operator 1 against a plain version over random sites, and on sites of copies, menus and long pages."""

import random

import pytest

from lexiloom.llm import html


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, z string")


def longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n)) + str(rng.random())


def site(rng, host, n):
    """Pages with a menu, a notice and an own text; what is shared by the neighbours alone is known."""
    menu, notice = [words(rng, 3) for _ in range(4)], words(rng, 12)
    out = []
    for k in range(n):
        own = [words(rng, 30) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<div>{x}</div>" for x in [*menu, *own, notice])
        out.append((f"http://{host}/p{k:03d}", body, own))
    return out


def test_random_sites(spark, monkeypatch):
    rng = random.Random(4)
    made = [p for h, n in (("a.com", 150), ("b.com", 2), ("c.com", 1), ("d.org", 40)) for p in site(rng, h, n)]
    rng.shuffle(made)
    got = {r.page_id: r for r in html.extract(pages(spark, [(u, h) for u, h, _ in made])).collect()}
    assert len(got) == len(made)
    for i, (url, body, own) in enumerate(made):
        whole = [x.removeprefix("<div>") for x in body.split("</div>") if x]
        assert got[i].text.split("\n") == (whole if "c.com" in url else own), url
        assert got[i].n_struck_lines == (0 if "c.com" in url else 5)


def test_the_longest_is_shared(monkeypatch):
    rng = random.Random(2)
    for bits in (1 << 26, 8):
        monkeypatch.setattr(html, "VECTOR_BITS", bits)
        for _ in range(200):
            a, b = ([rng.randint(0, rng.choice([2, 6, 20])) for _ in range(rng.randint(0, 12))] for _ in range(2))
            i, j = html.shared_lines(a, b)
            assert [a[k] for k in i] == [b[k] for k in j] and len(i) == longest(a, b)


def test_copies_and_menus(spark):
    rng = random.Random(5)
    menu = "".join(f"<div>{words(rng, 40)}</div>" for _ in range(12))
    big = [(f"http://menu.com/{k}", f"{menu}<p>{words(rng, 60)}</p>") for k in range(6)]  # nearly all of each page is shared
    text = "".join(f"<p>{words(rng, 40)}</p>" for _ in range(8))
    nav = "<div>Home</div><div>About us</div>"
    copies = [(f"http://copy.com/{k}", f"{nav}{text}<p>copy {k}</p>") for k in range(3)] + [(f"http://copy.com/z{k}", f"{nav}<p>{words(rng, 90)}</p>") for k in range(3)]
    twins = [(f"http://twin.com/{k}", text) for k in range(2)]
    got = {r.url: r.text.split("\n") for r in html.extract(pages(spark, big + copies + twins)).collect()}
    assert all(len(got[u]) == 1 for u, _ in big)
    assert [len(got[u]) for u, _ in copies] == [9, 9, 9, 1, 1, 1]
    assert all(len(got[u]) == 8 for u, _ in twins)


def test_quoted_articles_stay_whole(spark):
    quote = "<p>the very same words in both</p>"
    rows = [(f"http://q.com/{k}", f"<div>Menu</div><article><h1>t{k}</h1><p>{str(k) * 90}</p>{quote}</article>") for k in range(4)]
    got = html.extract(pages(spark, rows)).collect()
    assert all(r.text == f"t{r.page_id}\n{str(r.page_id) * 90}\nthe very same words in both" and (r.n_shared_lines, r.n_struck_lines, r.n_marked_lines) == (2, 1, 0) for r in got)


def test_long_pages_null_ids_and_repeated_rows(spark):
    rng = random.Random(6)
    common = [words(rng, 2) for _ in range(6000)]
    long = lambda seed: "".join(f"<p>{x}" for x in random.Random(seed).sample(common, 5000)) + f"<p>own {seed} " + "y" * 200_000
    rows = [("http://l.com/1", long(1)), ("http://l.com/2", long(2)), (None, "<p>no url"), (None, None)] + [("http://r.com/", "<p>again")] * 200
    docs = spark.createDataFrame([(None if i % 3 == 2 else i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    got = html.extract(docs).collect()
    assert len(got) == len(rows) and sum(r.text == "again" for r in got) == 200
    assert {r.text for r in got if r.url is None} == {"no url", ""}
    assert all(r.text.split("\n")[-1].startswith("own") for r in got if r.url and "l.com" in r.url)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p data-hidden="false">a<p title="hidden gems" data-id="ad-17">b', ["a", "b"]),
        ("<main><p>Main body</p><article class=card>teaser</article></main>", ["Main body"]),
        ("<article><p>a <label>b</label> c <button>d</button> e</article>", ["a b c d e"]),
        ("<article><p>a</p><button>Share</button><p>b</article>", ["a", "b"]),
        ('<div id="discussion"><p>all of it</div>', ["all of it"]),
        ("<main><article>one</article><article>two</article></main>", ["one", "two"]),
    ],
)
def test_markup(page, want):
    lines = html.lines_of(page)
    assert [t for z, t in lines if z == html.main_zone("".join(z for z, _ in lines))] == want
