"""Page text and URL verdicts on hand-written pages."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from ledgerline.llm import pages, urls
from ledgerline.llm.work import Scratch

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x -->
<div class="ad">Buy</div><div class="cookie-notice"><p>Cookies</p></div>
<article><h1>{0}</h1><p><b>First {0} &amp; more.<br><p>Second&nbsp;line
 here<aside>Related</aside><form>Mail <input></form><ul><li>a<li>b</ul><div class="share">Share</div></article>
<section id="comments"><article>reader says</article></section>
<aside>Side</aside><footer>&copy; Foot</footer>"""
WANT = "{0}\n\nFirst {0} & more.\n\nSecond line here\n\na\n\nb"
PLAIN = """<div id="top"><a href="/">Home</a> <a href="/x">News</a></div><div class="hd">Daily Planet</div>
<div class="box"><div class="txt"><p>{0} one two three</p><p>Second {0} text</p></div>
<div class="comments"><p>nice</p></div></div><div class="low">Copyright Planet</div>"""


def test_article_without_the_rest():
    assert pages.main_text(ARTICLE.format("Topic")) == WANT.format("Topic")


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"),
        ("&lt;b&gt; x&#233;</p>", "<b> xé"),
        ("<article><p>a<br>b<p>c</article>", "a b\n\nc"),
        ("<main><p>x</main>", "x"),
        ("<p>a</div></div><p>b", "a\n\nb"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n\n2\n\n3"),
        ("<div class='advice'><p>kept</p></div>", "kept"),
        ("<nav>x<article>y</article></nav>", ""),
        ("<p>" + "w " * 50_000 + "</p>", "w " * 49_999 + "w"),
    ],
)
def test_odd_pages(html, text):
    assert pages.main_text(html) == text


def test_wrapper_tells_template_from_slots():
    own = [PLAIN.format(w) for w in ("alpha", "beta", "gamma", "delta")]
    found = pages.induce(own)
    assert pages.main_text(own[0], found) == "alpha one two three\n\nSecond alpha text"
    assert pages.induce(own[:2]) == pages.Wrapper()
    # without a wrapper the constant blocks can't be told apart
    assert "Daily Planet" in pages.main_text(own[0])


def test_template_inside_an_article():
    """A notice without a telling class, after articles of different lengths."""
    own = [
        f"<body><article><h1>{w}</h1>" + "".join(f"<p>{w} {i}</p>" for i in range(n)) + "<p>Read on in our app.</p></article>"
        for n, w in enumerate(("alpha", "beta", "gamma", "delta"), 1)
    ]
    found = pages.induce(own)
    assert pages.main_text(own[1], found) == "beta\n\nbeta 0\n\nbeta 1"
    assert "Read on" in pages.main_text(own[1])
    copy = "<body><article><p>Read on in our app.</p></article>"
    assert pages.main_text(copy, found) == "Read on in our app."


def test_all_varying_slots_are_kept():
    """A headline and a second part beside the largest part, and bodies of many like elements."""

    def page(w, n):
        body = "".join(f"<div class=para><p>{w} paragraph {i}</p></div>" for i in range(n))
        return (
            f"<body><div class=top>Planet</div><h1><a href=x>Title {w}</a></h1><div class=by>By {w}</div>{body}"
            f"<div class=part-b><p>Rest of {w}</p></div><div class=low>Imprint</div></body>"
        )

    found = pages.induce([page(w, n) for w, n in (("alpha", 20), ("beta", 15), ("gamma", 5), ("delta", 13))])
    for w, n in (("alpha", 20), ("gamma", 5)):
        want = [f"Title {w}", f"By {w}", *[f"{w} paragraph {i}" for i in range(n)], f"Rest of {w}"]
        assert pages.main_text(page(w, n), found) == "\n\n".join(want)
    tree = pages.simplified(pages.Page(page("alpha", 20)).root)
    paras = [c for c in tree.children[0].children if c.kind == "div.para#"]
    assert len(paras) == 1 and [t for c in paras[0].children for t in c.blocks] == [f"alpha paragraph {i}" for i in range(20)]


def test_tree_match_counts_what_keeps_order():
    def tree(text):
        return pages.simplified(pages.Page(text).root)

    a = tree("<div><p>1</p><ul><li>x</li></ul><h2>t</h2></div>")
    b = tree("<div><h2>t</h2><p>2</p><ul><li>y</li><li>z</li></ul></div>")
    size, pairs = pages.tree_match(a, b)
    assert size == len(pairs) == 5  # root, div, p, ul, li
    assert {x.tag for x, _ in pairs} == {"", "div", "p", "ul", "li"}


def test_pages_of_hosts(spark):
    rows = [(i, f"http://A.example/{i}", PLAIN.format(f"word{i}")) for i in range(8)]
    rows += [(20, "http://b.example/x", ARTICLE.format("Solo")), (20, "http://b.example/x", ARTICLE.format("Solo"))]
    rows += [(30, None, None), (31, "no host", ""), (32, "http://c/", "<p>only"), (None, "http://c/", "<p>other")]
    schema = "page_id bigint, url string, html string, host string, text string, content string"
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], schema)
    out = pages.extracted(df, Scratch(spark, "t"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"word{i} one two three\n\nSecond word{i} text" for i in range(8))
    assert by[20] == WANT.format("Solo") and by[30] == by[31] == "" and by[32] == "only" and by[None] == "other"
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.extracted(df.limit(0), Scratch(spark, "t")).collect() == []


def test_wrapper_covers_all_pages_of_a_host(spark):
    """Odd pages and a second layout with other template texts at the same places."""

    def page(layout, i, low):
        return f"<body><div class={layout}><p>Text {layout} {i}</p><p>More {layout} {i}</p></div><div class=low>{low}</div></body>"

    rows = [(i, page("a", i, "Imprint")) for i in range(40)] + [(100 + i, page("b", i, "Branch office")) for i in range(5)]
    odd = [(200 + i, f"<body><h2>Error {i}</h2><div class=low>Code {i}</div></body>") for i in range(10)]
    df = spark.createDataFrame([(i, f"http://h.net/{i}", t) for i, t in rows + odd], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extracted(df, Scratch(spark, "t")).collect()}
    assert all(got[i] == f"Text a {i}\n\nMore a {i}" for i in range(40))
    assert all(got[100 + i] == f"Text b {i}\n\nMore b {i}" for i in range(5))
    assert all(got[200 + i] == f"Error {i}\n\nCode {i}" for i in range(10))
    wrapper = pages.induce([t for _, t in rows + odd])
    assert all(pages.main_text(t, wrapper) == got[i] for i, t in rows + odd)


def test_texts_that_wander_are_content():
    turn = ["<h2>Good</h2><h2>Bad</h2>", "<h2>Bad</h2><h2>Good</h2>"]
    own = [f"<article>{turn[i > 0]}<p>{i}</p><p>Imprint</p></article>" for i in range(3)]
    assert len(pages.wandering(own)) == 1  # of two that change places, one is aligned
    assert "Imprint" not in pages.main_text(own[0], pages.induce(own))
    assert any(word in pages.main_text(own[0], pages.induce(own)) for word in ("Good", "Bad"))


def test_alignment_decides_on_every_frequent_text(spark):
    """Texts that change places are content where few pages of a layout have them, too; both orders are told apart."""

    def page(i):
        turn = ("<li>Good<li>Bad", "<li>Bad<li>Good")[i % 2] if i < 4 else ""
        return f"<body><p>Own words {i}</p><ul class=turn>{turn}</ul><p>Own end {i}</p><p>Imprint</p></body>"

    own = [page(i) for i in range(120)]
    df = spark.createDataFrame([(i, f"http://h.net/{i}", t) for i, t in enumerate(own)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extracted(df, Scratch(spark, "t")).collect()}
    wrapper = pages.induce(own)
    for i, html in enumerate(own):
        for text in (got[i], pages.main_text(html, wrapper)):
            # of two that change places one is aligned, and so may be template
            between = text.removeprefix(f"Own words {i}\n\n").removesuffix(f"Own end {i}").strip()
            assert between in ({"Good", "Bad"} if i < 4 else {""})
    assert len({got[i] for i in range(4)}) == 4 and "Imprint" not in "".join(got.values())
    assert len(pages.constants([own[0], own[1]])) == 2  # Imprint, and one of two that change places


def test_all_pages_that_have_a_text_are_aligned(spark):
    """Two texts keep their order on the pages of the lowest hashes and change places on most others."""

    def page(i, turn):
        return f"<body><p>Own words {i}</p><ul class=turn>{turn}</ul><p>Own end {i}</p><p>Imprint</p></body>"

    both = [[page(i, turn) for turn in ("<li>Good<li>Bad", "<li>Bad<li>Good")] for i in range(200)]
    made = spark.createDataFrame([(i, *b) for i, b in enumerate(both)], "i int, a string, b string")
    hashes = made.selectExpr("i", "xxhash64(a) AS a", "xxhash64(b) AS b").collect()
    low = sorted(r.a for r in hashes)[8]
    own = [both[r.i][r.a >= low] for r in hashes if r.a < low or r.b >= low]
    df = spark.createDataFrame([(i, f"http://h.net/{i}", t) for i, t in enumerate(own)], "page_id bigint, url string, html string")
    got = [r.text for r in pages.extracted(df, Scratch(spark, "t")).collect()]
    assert len({word for text in got for word in ("Good", "Bad") if word in text}) == 1
    assert all("Good" in text or "Bad" in text for text in got) and "Imprint" not in "".join(got)


def test_outlines_align_as_their_pages_do():
    rng = random.Random(19)
    some = ["".join(rng.choices(["<p>a", "<p>b", "<h2>c</h2>", "<ul><li>d<li>e</ul>", "<div>f"], k=rng.randint(1, 9))) for _ in range(60)]
    trees = [pages.simplified(pages.Page(html).root) for html in some]
    first = pages.Aligned(pages.outline(trees[0]))
    for tree in trees:
        pairs = pages.tree_match(trees[0], tree)[1]
        want = {pages._mark(x.path, t) for x, y in pairs for t in set(x.blocks) & set(y.blocks)}
        assert first.with_page(pages.outline(tree)) == first.with_page(pages.outline(tree)) == want


# --- URLs


def plain_judgement(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD_URLS = [
    None, "", "no scheme", "http://", "http:///p", "HTTP://WWW.Example.NET/en/1?q#f", "http://net/", "http://xnet/", "http://a.net",
    "http://example.com/de/", "http://example.com/de", "http://a.example.com/de/x?y=/fr/", "ftp://x.org/fr/a/b/c/d", "http://x.org#/fr/",
    "http://é.net/ü/", "a://b://c.net/", "http://example.net/EN/", "http://h\n.net/x\ny",
]


def pages_of(spark, all_urls):
    schema = "page_id bigint, url string, host string, label int, template string"
    return spark.createDataFrame([(i, u, "clash", 7, "t") for i, u in enumerate(all_urls)], schema)


def test_rules(spark):
    got = urls.judged(pages_of(spark, ODD_URLS * 2), Scratch(spark, "t")).collect()
    assert len(got) == 2 * len(ODD_URLS)
    for r in got:
        host, path, rule, verdict = plain_judgement((ODD_URLS * 2)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judged(pages_of(spark, []), Scratch(spark, "t")).collect() == []


def test_templates_blank_what_varies_and_reject_by_labels(spark):
    rows = [("h", f"/news/{i}/story-{i}", 0 if i % 2 else None) for i in range(40)]
    rows += [("h", f"/casino/{i}", 1 if i < 30 else None) for i in range(40)]
    rows += [("h", f"/{word}/page", None) for word in "ab cd ef gh".split() for _ in range(5)]
    rows += [("g", f"/casino/{i}", None) for i in range(20)] + [("k", "/casino/1", 1), ("k", "", None), ("k", "//", None)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    got = {(r.host, r.path): r for r in urls.templates(df, Scratch(spark, "t")).collect()}
    assert len(got) == len({r[:2] for r in rows})
    assert {got["h", f"/news/{i}/story-{i}"].template for i in range(40)} == {"/news/{n}/story-{n}"}
    assert {got["h", f"/casino/{i}"].template for i in range(40)} == {"/casino/{n}"}
    assert len({got["h", f"/{w}/page"].template for w in "ab cd ef gh".split()}) == 1
    casino = got["h", "/casino/39"]
    assert casino.rejected and casino.purity == 31 / 32 and casino.template_labels == 30
    assert not got["h", "/news/1/story-1"].rejected and not got["g", "/casino/5"].rejected
    # one label is no proof; labelled and unlabelled paths part on a small host too
    assert not got["k", "/casino/1"].rejected and got["k", "/casino/1"].template == "/casino/**"
    assert got["k", ""].template == got["k", "//"].template == ""


def slow_templates(urls, settings=urls.Settings()):
    """The tree of one host in plain Python, a segment at a time: template of each path."""
    import math

    def shape(segment):
        segment = re.sub(r"(?i)(?=[0-9a-f-]*[0-9])[0-9a-f]{8}[0-9a-f-]*", "{x}", segment)
        return re.sub(r"[0-9]+", "{n}", segment)

    def differs(own, own_n, whole, whole_n, more):
        rest, rest_n = whole - own + more, whole_n - own_n + 2 * more
        own, own_n = own + more, own_n + 2 * more
        if own_n <= 0 or rest_n <= 0:
            return False
        pooled = (own + rest) / (own_n + rest_n)
        return abs(own / own_n - rest / rest_n) > settings.differ * math.sqrt(pooled * (1 - pooled) * (1 / own_n + 1 / rest_n))

    rows = defaultdict(lambda: [0, 0, 0])
    for path, label in urls:
        row = rows[path]
        row[0], row[1], row[2] = row[0] + 1, row[1] + (label or 0), row[2] + (label is not None)
    split = {path: [s for s in path.split("/") if s] for path in rows}
    nodes, done = {"": list(rows)}, {}
    depth = 0
    while nodes:
        following = defaultdict(list)
        for template, paths in nodes.items():
            crowd, marked = sum(rows[p][0] for p in paths), sum(rows[p][2] for p in paths)
            on = [p for p in paths if len(split[p]) > depth]
            if crowd < settings.support and not 0 < marked < crowd:
                done.update({p: template + ("/**" if p in on else "") for p in paths})
                continue
            done.update({p: template for p in paths if p not in on})
            kinds = defaultdict(list)
            for p in on:
                kinds[shape(split[p][depth])].append(p)

            def sums(some, depth=depth):
                n, bad, labelled = (sum(rows[p][k] for p in some) for k in range(3))
                return n, bad, labelled, sum(rows[p][0] for p in some if len(split[p]) == depth + 1)

            all_n, all_bad, all_labelled, all_ends = sums(on)
            for kind, some in kinds.items():
                n, bad, labelled, ends = sums(some)
                unlike = differs(bad, labelled, all_bad, all_labelled, 1) or differs(ends, n, all_ends, all_n, 0)
                merged = len(kinds) >= 3 and (len(kinds) * 2 > all_n or not unlike)
                values = {split[p][depth] for p in some}
                for p in some:
                    token = "*" if merged else kind if len(values) > 1 else split[p][depth]
                    following[f"{template}/{token}"].append(p)
        nodes, depth = following, depth + 1
    return done


def test_tree_against_plain_python(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(500):
        parts = [rng.choice(["de", "en", "shop", "a1", "b2", f"item-{rng.randrange(40)}", "x", "y"]) for _ in range(rng.randint(0, 5))]
        rows.append(("h.example", "/" + "/".join(parts), rng.choice([None, None, 1 if "de" in parts else 0])))
    rows += [("h.example", "/deep" + "/same" * 30 + f"/{i % 9}", None) for i in range(30)]
    rows += [("small.example", p, label) for p, label in (("/de/963", 1), ("/de/216.html", 1), ("/en/27", None))]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    found = {(r.host, r.path): r for r in urls.templates(df, Scratch(spark, "t")).collect()}
    for host in ("h.example", "small.example"):
        want = slow_templates([(p, label) for h, p, label in rows if h == host])
        assert {p: r.template for (h, p), r in found.items() if h == host} == want
    assert found["small.example", "/de/963"].rejected and not found["small.example", "/en/27"].rejected


def test_long_chains_take_few_rounds(spark):
    scratch = Scratch(spark, "t")
    rows = [("h", "/a" * 200 + f"/{i}", None) for i in range(20)] + [("h", "/a" * 200, None)] * 3
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, label int"), scratch).collect()
    assert {r.template for r in found} == {"/a" * 200 + "/{n}", "/a" * 200}
    assert len(list(Path(scratch.path.removeprefix("file:")).glob("level-*"))) <= 4
