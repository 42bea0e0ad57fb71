"""Main text of web pages by wrappers induced from pages of one host.

Pages of a host come from a few templates.  Aligning element trees of pages by
simple tree matching finds the constant blocks, which stand with one text at
nodes aligned with each other.  One that also recurs at its place on most pages
of the host, or of one layout of it, is template: that is counted over all
pages.  What varies (slots) and isn't noise is the article.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.urls import host_and_path
from ledgerline.llm.work import Scratch

#: A text is template if it stands on this share of the distinct pages that have its place, and on so many at least.
SHARE, LEAST = 0.6, 3

#: Elements whose paths, down to ``DEEP`` of them, make up the layout of a page.
FRAME, DEEP = set("html body div section article main header footer nav aside center form".split()), 4

#: An article of which less than this share varies, of blocks and of text, is a near copy of others, not a template
#: around little text.
COPY = 0.5

#: Siblings of one kind aligned one by one; more of them are a list, aligned as a whole.
LIST = 12

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPH, NOT_PARAGRAPH = {"p"}, BLOCK - {"p"}
UNSHOWN = set("script style noscript template head title svg math iframe object canvas audio video textarea select".split())
NOISE_TAGS = set("nav footer aside form dialog menu search button fieldset".split()) | UNSHOWN
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id that mark what isn't the article.
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices notification disclaimer sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer"
    " masthead comment comments disqus replies share sharing social related recommended recommendations newsletter"
    " subscribe subscription signup login popup modal overlay widget toolbar pagination pager".split()
)
#: Those of them that also hold for an article of its own inside.
STRICT_WORDS = set("ad ads advert comment comments disqus replies related recommended sidebar sponsored".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


@dataclass
class Node:
    """An element: kind (tag with class and id), noise level (0 none, 1 by name, 2 by tag), own text blocks."""

    tag: str
    kind: str
    noise: int
    within: bool
    path: int  # a hash, so that deep nesting costs no more
    holder: Node | None = None  # the innermost block element at or above it
    children: list[Node] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)


@dataclass
class Block:
    """Text between two block boundaries, with the element it stands in; linked: characters inside links."""

    text: str
    node: Node
    linked: int


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) & 0x7FFF_FFFF_FFFF_FFFF


@lru_cache(1 << 16)
def _step(kind: str, path: int) -> int:
    """The path of an element of that kind under ``path``."""
    return _hash(kind, path)


@lru_cache(1 << 16)
def _names(classes: str, name: str) -> tuple[frozenset[str], str]:
    """The words that class and id of an element say, and what they add to its kind."""
    said = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{classes} {name}").lower())
    return frozenset(said), re.sub(r"\d+", "0", f"{'.'.join(sorted(classes.split()))}#{name}")


class Page(HTMLParser):
    """A page as element tree and list of text blocks; forgiving about tags left open or closed twice.

    Work grows with the length of the page, however deep its elements nest.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", 0, False, 0)
        self.root.holder = self.root
        self.open, self.blocks, self.pieces, self.linked = [self.root], [], [], 0
        self.count: Counter[str] = Counter()  # open elements by tag
        self.hidden = 0  # those of them whose text isn't shown
        self.feed(html)
        self.close()
        self._flush()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...>`` is no part of HTML: a comment up to the next ``>``, as browsers take it."""
        return self.parse_bogus_comment(i)

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            node = self.open[-1].holder
            node.blocks.append(text)
            self.blocks.append(Block(text, node, self.linked))
        self.pieces, self.linked = [], 0

    def _pop_to(self, tags: set[str], until: set[str]) -> None:
        """Close the innermost open element of ``tags`` and all inside it, if no element of ``until`` lies between."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                for node in self.open[i:]:
                    self.count[node.tag] -= 1
                    self.hidden -= node.tag in UNSHOWN
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def _noise(self, tag: str, role: str | None, said: frozenset[str], above: Node) -> int:
        if tag in ("html", "body"):
            return 0
        if tag in ("main", "article"):
            return 2 if said & STRICT_WORDS or above.noise == 2 else 0
        if above.noise == 2 or tag in NOISE_TAGS or role in NOISE_ROLES or said & STRICT_WORDS:
            return 2
        if tag == "header" and not above.within:
            return 2
        return 1 if above.noise or said & NOISE_WORDS or (not above.within and "header" in said) else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
            if tag in CLOSES:
                self._pop_to(CLOSES[tag], HOLDS.get(tag, set()) | {"table"})
            if tag not in ("html", "body"):
                self._pop_to(PARAGRAPH, NOT_PARAGRAPH)
        elif tag in ("br", "wbr", "img", "input"):
            self.pieces.append("" if tag == "wbr" else " ")
        if tag in VOID:
            return
        above, given = self.open[-1], dict(attrs)
        said, shown = _names(given.get("class") or "", given.get("id") or "")
        noise = self._noise(tag, given.get("role"), said, above)
        kind = tag if shown == "#" else f"{tag}.{shown}"
        within = above.within or (tag in ("article", "main") and not noise)
        node = Node(tag, kind, noise, within, _step(kind, above.path) if block else above.path)
        node.holder = node if block else above.holder
        if block:
            above.holder.children.append(node)
        self.open.append(node)
        self.count[tag] += 1
        self.hidden += tag in UNSHOWN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in ("body", "html"):
            return
        self._pop_to({tag}, set() if tag in BLOCK else BLOCK)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.pieces.append(data)
        if self.count["a"]:
            self.linked += len(data.strip())


def simplified(node: Node) -> Node:
    """The tree without noise by tag, with long lists of like siblings drawn together, children and all."""

    def copy(n: Node) -> Node:
        return Node(n.tag, n.kind, n.noise, n.within, n.path, None, [*n.children], [*n.blocks])

    top = copy(node)
    todo = [top]
    while todo:
        own = todo.pop()
        kept = [c for c in own.children if c.noise < 2]
        count = Counter(c.kind for c in kept)
        out: list[Node] = []
        lists: dict[str, Node] = {}
        for c in kept:
            if count[c.kind] > LIST and c.kind in lists:
                lists[c.kind].children += c.children
                lists[c.kind].blocks += c.blocks
            else:
                out.append(copy(c))
                lists[c.kind] = out[-1]
        own.children = out
        todo += out
    return top


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes that can be paired keeping kind, order and ancestry, and the pairs.

    A pair with text in common counts twice, so that a constant block is found after texts of any length.
    """
    if a.kind != b.kind:
        return 0, []
    order, todo = [], [(a, b)]
    while todo:  # parents before children
        x, y = todo.pop()
        order.append((x, y))
        todo += [(c, d) for c in x.children for d in y.children if c.kind == d.kind]
    score: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[Node, Node]]] = {}
    for x, y in reversed(order):
        rows, columns = len(x.children), len(y.children)
        best = [[0] * (columns + 1) for _ in range(rows + 1)]
        for i, c in enumerate(x.children, 1):
            for j, d in enumerate(y.children, 1):
                both = best[i - 1][j - 1] + score.get((id(c), id(d)), 0)
                best[i][j] = max(best[i - 1][j], best[i][j - 1], both)
        pairs, i, j = [], rows, columns
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x.children[i], y.children[j]))
        score[id(x), id(y)] = best[rows][columns] + 1 + bool(set(x.blocks) & set(y.blocks))
        chosen[id(x), id(y)] = pairs
    found, todo = [], [(a, b)]
    while todo:
        pair = todo.pop()
        found.append(pair)
        todo += chosen[id(pair[0]), id(pair[1])]
    return score[id(a), id(b)], found


def _mark(path: int, text: str) -> int:
    return _hash(text, path)


def seen(page: Page) -> tuple[int, int, set[tuple[int, int]]]:
    """Layout (above 0), identity, and places and marks of the blocks shown.

    Pages that show the same are one page, whatever else their source holds.
    """
    frame, stack = {0}, [(page.root, 0)]
    while stack:
        node, depth = stack.pop()
        inner = [c for c in node.children if c.tag in FRAME and not c.noise]
        frame.update(c.path for c in inner)
        stack += [(c, depth + 1) for c in inner if depth + 1 < DEEP]
    layout = _hash("\n".join(map(str, sorted(frame)))) & 0x7FFFFFFF | 1
    shown = [b for b in page.blocks if not b.node.noise]
    whole = _hash("\n".join(f"{b.node.path}\n{b.text}" for b in shown))
    return layout, whole, {(b.node.path, _mark(b.node.path, b.text)) for b in shown}


def outline(tree: Node) -> bytes:
    """A tree as numbers: for each node, parents first, its parent's place, its kind, and count and marks of its texts."""
    out, todo, place = array("q"), deque([(tree, -1)]), 0
    while todo:
        node, above = todo.popleft()
        out.extend((above, _step(node.kind, 0), len(node.blocks)))
        out.extend(_mark(node.path, text) for text in node.blocks)
        todo.extend((c, place) for c in node.children)
        place += 1
    return out.tobytes()


def _numbers(outlined: bytes) -> array:
    out = array("q")
    out.frombytes(outlined)
    return out


def _drawn(numbers: tuple[int, ...] | array) -> Node:
    """The tree of an outline; its texts are marks."""
    nodes, i = [], 0
    while i < len(numbers):
        above, kind, n = numbers[i : i + 3]
        nodes.append(Node("", kind, 0, False, 0, None, [], list(numbers[i + 3 : i + 3 + n])))
        if above >= 0:
            nodes[above].children.append(nodes[-1])
        i += 3 + n
    return nodes[0]


class Aligned:
    """Marks of texts at nodes of pages aligned with those of one page, which have them too.

    Of a page's texts only those on the first page tell how the two are aligned:
    pages alike but for other texts are aligned once.
    """

    #: Alignments kept at most.
    KEPT = 4096

    def __init__(self, first: bytes):
        numbers = _numbers(first)
        self.first, self.marks, self.kept, todo = _drawn(numbers), set(), {}, 0
        while todo < len(numbers):
            n = numbers[todo + 2]
            self.marks.update(numbers[todo + 3 : todo + 3 + n])
            todo += 3 + n

    def with_page(self, outlined: bytes) -> frozenset[int]:
        numbers, known, i = _numbers(outlined), [], 0
        while i < len(numbers):
            n = numbers[i + 2]
            own = [mark for mark in numbers[i + 3 : i + 3 + n] if mark in self.marks]
            known += [numbers[i], numbers[i + 1], len(own), *own]
            i += 3 + n
        key = tuple(known)
        if key not in self.kept:
            if len(self.kept) >= self.KEPT:
                self.kept.clear()
            pairs = tree_match(self.first, _drawn(key))[1]
            self.kept[key] = frozenset(mark for x, y in pairs for mark in set(x.blocks) & set(y.blocks))
        return self.kept[key]


def _alignment(pages: list[str]) -> tuple[Counter[int], Counter[int]]:
    """Marks of texts on the first page: others that have them, and others that have them at nodes aligned with it."""
    trees = [simplified(Page(html).root) for html in pages]

    def marks(tree: Node) -> set[int]:
        found, stack = set(), [tree]
        while stack:
            node = stack.pop()
            found.update(_mark(node.path, text) for text in node.blocks)
            stack += node.children
        return found

    met, aligned, first = Counter(), Counter(), marks(trees[0]) if trees else set()
    for other in trees[1:]:
        met.update(first & marks(other))
        pairs = tree_match(trees[0], other)[1]
        aligned.update({_mark(x.path, text) for x, y in pairs for text in set(x.blocks) & set(y.blocks)})
    return met, aligned


def wandering(pages: list[str]) -> set[int]:
    """Marks of texts that are on several of the pages, mostly not at nodes aligned with the first page's."""
    met, aligned = _alignment(pages)
    return {mark for mark, n in met.items() if n > 1 and aligned[mark] * 2 < n}


def constants(pages: list[str]) -> set[int]:
    """Marks of the constant blocks: texts that half of the other pages that have them, at least, have at nodes aligned
    with the first page's."""
    met, aligned = _alignment(pages)
    return {mark for mark, n in met.items() if aligned[mark] * 2 >= n}


@dataclass(frozen=True)
class Wrapper:
    """constant: marks of template blocks, of those of one layout only mixed with it; none if too few pages are known."""

    constant: frozenset[int] = frozenset()

    def holds(self, layout: int, block: Block) -> bool:
        mark = _mark(block.node.path, block.text)
        return mark in self.constant or layout << 32 ^ mark in self.constant


def induce(pages: list[str]) -> Wrapper:
    """The wrapper of pages of one host, as ``extracted`` finds it where they are many."""
    found = {}
    for html in pages:
        layout, page, marks = seen(Page(html))
        found.setdefault(page, (layout, marks, html))
    count = Counter()
    held = [{mark for _, mark in marks} for _, marks, _ in found.values()]
    texts = [html for _, _, html in found.values()]
    for layout, marks, _ in found.values():
        for at in (0, layout):
            count.update((at, *m) for m in marks | {(path, None) for path, _ in marks})
    frequent = {
        (at, mark)
        for (at, path, mark), n in count.items()
        if mark is not None and n >= LEAST and n >= SHARE * count[at, path, None]
    }
    own, together = {}, {}
    for wanted in {mark for _, mark in frequent}:
        own[wanted] = [i for i, marks in enumerate(held) if wanted in marks]
        together.setdefault(own[wanted][0], set()).update(own[wanted])
    firm = {first: constants([texts[i] for i in sorted(some)]) for first, some in together.items()}
    frequent = {(at, mark) for at, mark in frequent if mark in firm[own[mark][0]]}
    return Wrapper(frozenset(at << 32 ^ mark for at, mark in frequent if not at or (0, mark) not in frequent))


def _varying(blocks: list[Block], wrapper: Wrapper, layout: int) -> list[Block]:
    """The blocks that aren't template, and headings right ahead of one of them."""
    out: list[Block] = []
    following = False
    for b in reversed(blocks):
        varies = not wrapper.holds(layout, b)
        if varies or (following and b.node.tag in HEADINGS):
            out.append(b)
            following = True
        else:
            following = False
    return out[::-1]


def _link_lists(blocks: list[Block]) -> set[str]:
    """Paths at which there are several blocks, nearly all of it links."""
    chars: dict[str, list[int]] = {}
    for b in blocks:
        n = chars.setdefault(b.node.path, [0, 0, 0])
        n[0], n[1], n[2] = n[0] + 1, n[1] + len(b.text), n[2] + b.linked
    return {path for path, (n, size, linked) in chars.items() if n > 1 and linked * 10 > size * 9}


def main_text(html: str | None, wrapper: Wrapper = Wrapper()) -> str:
    """Blocks of the article in page order, joined by two line breaks; empty if there are none.

    Template blocks go on every page, but a heading stays with varying text that
    follows it.  An ``article`` or ``main`` element that isn't marked otherwise
    bounds the article; if less than COPY of its blocks and of its text varies, the
    page is a copy or near copy of others and it stays whole.  Without such an element the article is all
    that varies, less noise and lists of links; where no template is known, less
    every block that is mostly links.
    """
    page = Page(html or "")
    shown = [b for b in page.blocks if not b.node.noise]
    tagged = [b for b in shown if b.node.within]
    layout = seen(page)[0] if wrapper.constant else 0
    shown = _varying(shown, wrapper, layout)
    inside = [b for b in shown if b.node.within]
    if len(inside) < COPY * len(tagged) and sum(len(b.text) for b in inside) < COPY * sum(len(b.text) for b in tagged):
        inside = tagged
    if not inside and wrapper.constant:
        lists = _link_lists(shown)
        inside = [b for b in shown if b.node.path not in lists]
    elif not inside:
        inside = [b for b in shown if b.linked * 2 <= len(b.text)]
    return "\n\n".join(b.text for b in inside)


def extracted(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty pages give an empty text.  Pages without a host are a host of
    their own; repeated rows stay.  A host's wrapper is counted over all its
    distinct pages, by layout and as a whole.  For every text so found all distinct
    pages that have it are aligned with the first of them: only constant blocks
    become template.  It is applied to every page of the host.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_and_path(F.col("url"))[0])
    known = rows.filter(F.length("html") > 0).select("host", "html", F.xxhash64("html").alias("hash"))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host", "hash", "layout", "page", "paths", "marks", "outline"]
        for frame in frames:
            out = []
            for host, html, key in zip(frame["host"], frame["html"], frame["hash"]):
                own = Page(html)
                layout, page, marks = seen(own)
                if marks:
                    paths, texts = zip(*sorted(marks))
                    out.append((host, key, layout, page, list(paths), list(texts), outline(simplified(own.root))))
            if out:
                yield pd.DataFrame(out, columns=names)

    shape = "host string, hash bigint, layout bigint, page bigint, paths array<bigint>, marks array<bigint>, outline binary"
    # a page counts once; keyed by page, so that a large host spreads
    once = known.mapInPandas(look, shape).groupBy("host", "layout", "page")
    once = once.agg(F.min(F.struct("hash", "paths", "marks", "outline")).alias("own")).select("host", "layout", "own.*")
    once = scratch.write(once, "pages")

    marks = once.select("host", "layout", "hash", F.explode(F.arrays_zip("paths", "marks")).alias("at"))
    marks = marks.select("host", "layout", "hash", F.col("at.paths").alias("path"), F.col("at.marks").alias("mark"))
    place = once.select("host", "layout", "hash", F.explode(F.array_distinct("paths")).alias("path"))
    place = place.withColumn("mark", F.lit(-1).cast("long"))
    by_layout = marks.unionByName(place).groupBy("host", "layout", "path", "mark")
    by_layout = by_layout.agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first"))
    by_layout = scratch.write(by_layout, "by_layout")
    whole = by_layout.groupBy("host", "path", "mark").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    whole = scratch.write(whole.filter((F.col("mark") < 0) | (F.col("n") >= LEAST)), "whole")
    counted = by_layout.drop("first").unionByName(whole.drop("first").withColumn("layout", F.lit(0).cast("long")))
    places = counted.filter("mark = -1").select("host", "layout", "path", F.col("n").alias("pages"))
    frequent = counted.filter((F.col("mark") >= 0) & (F.col("n") >= LEAST)).join(places, ["host", "layout", "path"])
    frequent = frequent.filter(F.col("n") >= F.col("pages") * SHARE).select("host", "layout", "mark").distinct()
    frequent = scratch.write(frequent, "frequent")

    texts = whole.join(frequent.select("host", "mark").distinct(), ["host", "mark"]).select("host", "mark", "first", "n")
    texts = scratch.write(texts, "texts")
    # a row for each page and each first page whose texts it has: no task needs all pages of a host or text
    others = marks.join(texts, ["host", "mark"]).filter("hash <> first").groupBy("host", "first", "hash")
    others = others.agg(F.collect_set("mark").alias("marks")).join(once.select("host", "hash", "outline"), ["host", "hash"])
    firsts = once.select("host", F.col("hash").alias("first"), F.col("outline").alias("first_outline"))
    firsts = texts.select("host", "first").distinct().join(firsts, ["host", "first"])

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, Aligned] = {}
        for frame in frames:
            count: Counter[tuple[str, int]] = Counter()
            for host, wanted, own, first in zip(frame["host"], frame["marks"], frame["outline"], frame["first_outline"]):
                if first not in kept:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[first] = Aligned(first)
                count.update((host, mark) for mark in kept[first].with_page(own) & set(wanted.tolist()))
            if count:
                yield pd.DataFrame([(*key, n) for key, n in count.items()], columns=["host", "mark", "aligned"])

    aligned = others.join(firsts, ["host", "first"]).select("host", "marks", "outline", "first_outline")
    aligned = aligned.mapInPandas(align, "host string, mark bigint, aligned bigint")
    aligned = aligned.groupBy("host", "mark").agg(F.sum("aligned").alias("aligned"))
    firm = texts.join(aligned, ["host", "mark"]).filter("aligned * 2 >= n - 1").select("host", "mark")
    template = frequent.join(firm, ["host", "mark"], "left_semi")
    everywhere = template.filter("layout = 0")
    template = template.filter("layout > 0").join(everywhere, ["host", "mark"], "left_anti").unionByName(everywhere)
    code = F.shiftleft("layout", 32).bitwiseXOR(F.col("mark"))
    wrappers = scratch.write(template.groupBy("host").agg(F.collect_set(code).alias("constant")), "wrappers")
    scratch.drop("pages", "by_layout", "whole", "frequent", "texts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, wrapper = None, Wrapper()
        for frame in frames:
            texts = []
            for host, html, constant in zip(frame["host"], frame["html"], frame["constant"]):
                if host != last:
                    last, wrapper = host, Wrapper(frozenset(constant.tolist()) if constant is not None else frozenset())
                texts.append(main_text(html, wrapper))
            out = frame[["page_id", "url"]].assign(text=texts)
            yield out.assign(n_chars=[len(t) for t in texts])

    id_type = pages.schema["page_id"].dataType.simpleString()
    both = rows.join(wrappers, "host", "left").select("host", "page_id", "url", "html", "constant")
    return both.mapInPandas(run, f"page_id {id_type}, url string, text string, n_chars bigint")
