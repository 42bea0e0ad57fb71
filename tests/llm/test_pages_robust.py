"""Pages of any form end in a text, and articles stay whole where others repeat them."""

import random

import pytest

from ledgerline.llm import pages

DEEP = 20_000
PIECES = [
    "<![", "<!", "<!--", "-->", "]]>", "<div>", "</div>", "<p>", "<script>", "</script>", "<title>", "</", "<a href='", "'>", ">", "x", "&#",
    "&amp", "<br/>", "<svg>", "<table><tr><td>", "\0", "é", "<?php", "<article>", "<textarea>", "<![CDATA[", "<![if ", "\ud800",
]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<![foo[x]]><p>a</p>", "a"),
        ("<p>a<![endif]>b</p>", "ab"),
        ("<div>" * DEEP + "deep" + "</div>" * DEEP, "deep"),
        ("<div>" * DEEP + "deep", "deep"),
        ("</div>" * DEEP + "t", "t"),
        ("<b>" * DEEP + "x" + "<p>y" * 3, "x\n\ny\n\ny\n\ny"),
        ("<p>a</p><script>var x = '<p>b'", "a"),
        ("&#xD800;&#x110000;", "��"),
    ],
)
def test_odd_pages(html, text):
    assert pages.main_text(html) == text
    assert pages.seen(pages.Page(html)) == pages.seen(pages.Page(html))
    assert isinstance(pages.wandering([html, html + "<p>z", html]), set)


def test_any_pieces_end():
    rng = random.Random(6)
    for _ in range(1500):
        html = "".join(rng.choices(PIECES, k=rng.randint(1, 60)))
        assert isinstance(pages.main_text(html), str)
        pages.seen(pages.Page(html))


def article(*blocks):
    return f"<html><body><div class='top'>Our site</div><article>{''.join(blocks)}</article><p>Terms of use</p></body></html>"


def test_near_copies_stay_whole():
    story = ["<h1>Title</h1>", *[f"<p>Paragraph {k} of the one story, the same in all its copies.</p>" for k in range(5)]]
    copies = [article(*story, f"<p>Correction {i} today.</p>") for i in range(6)]
    text = pages.main_text(copies[2], pages.induce(copies))
    assert text.startswith("Title\n\nParagraph 0") and text.endswith("Correction 2 today.") and "Terms" not in text


def test_headings_stay_with_what_follows():
    some = [
        article(
            *[f"<h2>{h}</h2><p>Words {i} on {h} that stand on no other page, {i * 7}.</p>" for h in ("Background", "Summary")],
            "<p>Share this page</p><h2>More like this</h2><p>Subscribe now</p>",
        )
        for i in range(6)
    ]
    text = pages.main_text(some[3], pages.induce(some))
    assert text == "\n\n".join(
        ["Background", "Words 3 on Background that stand on no other page, 21.", "Summary", "Words 3 on Summary that stand on no other page, 21."]
    )


def slow_match(a, b):
    """The best pairing by recursion over all ways."""
    if a.kind != b.kind:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), slow_match(x[0], y[0]) + best(x[1:], y[1:]))

    return best(a.children, b.children) + 1 + bool(set(a.blocks) & set(b.blocks))


def test_tree_matching_against_recursion():
    rng = random.Random(3)

    def tree(depth):
        node = pages.Node("div", rng.choice("ab"), 0, False, 0)
        node.blocks = rng.sample(["x", "y", "z"], rng.randint(0, 2))
        node.children = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return node

    for _ in range(200):
        a, b = tree(3), tree(3)
        score, pairs = pages.tree_match(a, b)
        assert score == slow_match(a, b)
        assert score == sum(1 + bool(set(x.blocks) & set(y.blocks)) for x, y in pairs)
