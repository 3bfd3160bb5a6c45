"""Operator 1 on pages whose markup names more than it should."""

import pytest

from lexiloom.llm import html


def text(page):
    lines = html.lines_of(page)
    main = html.main_zone("".join(z for z, _ in lines))
    return [t for z, t in lines if z == main]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="layout no-sidebar"><article><p>one<p>two</article></div>', ["one", "two"]),
        ('<div id="page" class="has-sidebar"><p>one</p><div class="sidebar">x</div></div>', ["one"]),
        ('<div class="content sidebar"><article><p>one</article></div><p>x', ["one"]),
        ('<div class="sidebar widget"><main><p>one</main></div>', ["one"]),
        ('<article><p class="legal">one<p class="search">two<div class="discussion">three</div><p class="bottom side">four</article>', ["one", "two", "three", "four"]),
        ('<article class="post no-comments"><p>one</article>', ["one"]),
        ('<html><head><title>t</title><meta charset="utf-8"><body><p>one</p></body></html>', ["one"]),
        ("<head><title>t</title><style>p{}</style><p>one", ["one"]),
        # what is not of the article stays out
        ('<article><p>one</article><div class="related"><article><p>longer than the text</article></div>', ["one"]),
        ('<div class="post"><p>one of the longest</div><div class="related"><article><p>short</article></div>', ["one of the longest"]),
        ('<article><p>one<div class="share-buttons">x</div><div class="related">x</div><p class="ad">x</article>', ["one"]),
        ('<div class="site-footer">x</div><nav class="no-sidebar"><article>x</article></nav><p>one', ["one"]),
        ('<div hidden><article><p>x</article></div><p>one', ["one"]),
    ],
)
def test_text_of_layouts(page, want):
    assert text(page) == want
