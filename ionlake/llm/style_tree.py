"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and ids are one node of
the host's tree. A node's presentation importance is the entropy of the child sequences it shows, its content
importance is one less the mean entropy of its texts over pages: what stands on all pages alike says nothing
about any. What the trees of all hosts say about a path stands in where a host has few pages. A branch goes when
no node in it is important, also inside an article and however long it is.

Marks in the page only lower the importance that the tree gives, to what needs texts that hardly ever repeat to stay:
for elements that HTML says are not the article (nav, footer, aside, ...), by telling class and id names, and outside
of an article, where the page marks one. They say nothing about a branch around the page's article, whatever its tags.
Trees start from a few made-up pages, on which such elements have half of the others' importance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch, slices

#: Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Of elements without readable text, and of those that HTML keeps for something else than the article.
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas button select textarea input dialog".split())
BESIDE = frozenset("nav footer aside form menu".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class and id names: for reader comments, and for what may be something else than the article.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])")
ROLES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|cookies?|footer|masthead|menu|nav|navbar|navigation|newsletter|pagination|popup|sidebar|signup|site-header|page-header|sponsor\w*|subscribe)(?:$|[\s_-])"
    r"|(?:^|\s)(?:site-|page-)?(?:banner|disclaimer|dropdown|modal|notice|overlay|promo|related|reply|share|sharing|social|toolbar|widget)(?:[_-](?:articles?|bar|box|buttons?|links?|list|posts?))?(?:$|\s)"
)
HIDDEN = re.compile(r"display:none|visibility:hidden")
MAIN = frozenset(("article", "main"))
#: Elements whose names say nothing about what is in them.
WHOLE = MAIN | {"html", "body"}

#: What marks leave of a branch's importance, for tags, roles and readers' comments and for all others; both are above
#: LOW, so that a branch whose texts never repeat can stay.
CERTAIN, LIKELY = 0.205, 0.21
GAMMA, LOW = 0.9, 0.2
#: Pages that all hosts' evidence weighs in a host's tree, and pages that one host weighs there at most.
SHARED, ONE_HOST = 32, 8
#: Pages that this evidence starts from, with importance 1, and for elements that are marked: their pages and importance.
START, MARKED_START, MARKED = 2, 16, 0.5

#: Pages of a host that get a copy of its tree together.
PAGES = 500

#: Presentation and content importance by path.
Tree = dict[int, tuple[float, float]]


class Node:
    __slots__ = ("children", "gone", "holds", "inside", "mark", "named", "out", "parent", "path", "sig", "size", "tag", "texts")

    def __init__(self, tag: str, sig: str, parent: Node | None, out: bool, mark: float = 1.0, named: float = 1.0) -> None:
        self.tag, self.sig, self.parent, self.out = tag, sig, parent, out
        self.mark, self.named, self.holds = mark, named, False  # by tag and role, by name; around an element of MAIN
        self.inside = tag in MAIN or bool(parent and parent.inside)
        self.size, self.gone = 0, False
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else ''}/{sig}") >> 1
        self.children: list[Node] = []
        self.texts: list[str] = []
        if parent:
            parent.children.append(self)


class Page(HTMLParser):
    """Builds the tree and the list of blocks: runs of (element, text) between block borders."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, False)
        self.blocks: list[list[tuple[Node, str]]] = [[]]
        self.feed(html)
        self.close()

    def _border(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _close(self, tags: tuple[str, ...], within: frozenset | None = None) -> None:
        node = self.at
        while node.parent and node.tag not in tags:
            if within is not None and node.tag not in within:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag == "head" and tag not in IN_HEAD:
            self.at = self.at.parent
        if tag in CLOSES_P:
            self._close(("p",), INLINE | {"p"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], INLINE | set(CLOSED_BY[tag]) | {"p"})
        if tag not in INLINE:
            self._border()
        if tag in VOID:
            return
        given = dict(attrs)
        name = re.sub(r"\d+", "0", f"{given.get('class') or ''} {given.get('id') or ''}".lower()).strip()
        sig = f"{tag}.{'.'.join(sorted(name.split()))}"
        out = self.at.out or tag in NO_TEXT or "hidden" in given or given.get("aria-hidden") == "true" or bool(HIDDEN.search((given.get("style") or "").replace(" ", "")))
        beside = tag in BESIDE or (tag == "header" and not self.at.inside) or (given.get("role") or "") in BESIDE_ROLES
        named = 1.0 if tag in WHOLE else CERTAIN if READERS.search(name) else LIKELY if ROLES.search(name) else 1.0
        self.at = Node(tag, sig, self.at, out, CERTAIN if beside else 1.0, named)
        node = self.at.parent if tag in MAIN and not out else None
        while node and not node.holds:
            node.holds, node = True, node.parent

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._border()
        if tag not in VOID:
            self._close((tag,))

    def handle_data(self, data: str) -> None:
        if not self.at.out:
            self.blocks[-1].append((self.at, data))
            node = self.at
            while node.tag in INLINE and node.parent:
                node = node.parent
            node.texts.append(data)


def parsed(html: str | None) -> Page:
    return Page(html or "")


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        one = stack.pop()
        if not one.out:
            yield one
            stack.extend(one.children)


def features(page: Page) -> list[tuple[int, int, int, bool]]:
    """(path, kind, feature, marked) once a page: kind 0 the sequence of children, kind 1 the element's own text."""
    found = set()
    below = below_marks(page, marks_of(page))
    for node in _walk(page.root):
        blocks = [c.sig for c in node.children if c.tag not in INLINE]
        marked = id(node) in below
        found.add((node.path, 0, xxhash.xxh3_64_intdigest("|".join(k for i, k in enumerate(blocks) if i == 0 or blocks[i - 1] != k)) >> 1, marked))
        text = " ".join("".join(node.texts).split())
        if text:
            found.add((node.path, 1, xxhash.xxh3_64_intdigest(text) >> 1, marked))
    return sorted(found)


def importances(page: Page, tree: Tree, marks: dict[int, float]) -> dict[int, float]:
    """Composite importance of each element, by id: its own presentation and text and the mean of its children's.

    Of elements that the site's tree doesn't mention the start is all there is: they are important, those in marked
    branches half as much.
    """
    found, below = {}, below_marks(page, marks)
    for node in reversed(list(_walk(page.root))):
        start = MARKED if id(node) in below else 1.0
        shown, said = tree.get(node.path, (start, start))
        inner = [found[id(c)] for c in node.children if not c.out and c.tag not in INLINE]
        if "".join(node.texts).strip():
            inner.append(said)
        weight = GAMMA ** len(inner)
        found[id(node)] = (1 - weight) * shown + weight * sum(inner) / len(inner) if len(inner) > 1 else inner[0] if inner else 0.0
    return found


def blocks_of(page: Page) -> list[tuple[Node, str]]:
    blocks = [(b[0][0], " ".join("".join(t for _, t in b).split())) for b in page.blocks if b]
    return [(node, t) for node, t in blocks if t]


def measured(page: Page) -> list[Node]:
    """The elements in page order, each with the size of the text below it."""
    for node, t in blocks_of(page):
        node.size += len(t)
    order = list(_walk(page.root))
    for node in reversed(order):
        if node.parent:
            node.parent.size += node.size
    return order


def article_of(page: Page, order: list[Node]) -> Node | None:
    """The element of MAIN with the most text, the outer of equals."""
    return max((n for n in order if n.tag in MAIN), key=lambda n: n.size, default=None)


def marks_of(page: Page) -> dict[int, float]:
    """What its own mark leaves of each element's importance, by id.

    Tags, roles and names say nothing about the branches around the page's article or, where it marks none, around
    half of its text.
    """
    order, found = measured(page), {}
    article, around = article_of(page, order), set()
    node = article
    while node:
        around.add(id(node))
        node = node.parent
    for node in order:
        if id(node) in around or (article is None and 2 * node.size >= page.root.size):
            found[id(node)] = 1.0
            continue
        mark = min(node.mark, node.named if not node.holds else 1.0)
        if node.parent and page.root.holds and node.parent.holds and not node.inside and not node.holds:
            mark = min(mark, LIKELY)
        found[id(node)] = mark
    return found


def below_marks(page: Page, marks: dict[int, float]) -> set[int]:
    """The marked elements and all below them, by id."""
    found: set[int] = set()
    for node in _walk(page.root):
        if marks[id(node)] < 1 or id(node.parent) in found:
            found.add(id(node))
    return found


def _gone(order: list[Node], goes) -> None:
    for node in order:
        node.gone = bool(node.parent and (node.parent.gone or goes(node)))


def main_text(html: str | None, tree: Tree) -> str:
    """The blocks outside of the branches in which nothing is important.

    A branch counts with its most important element, lowered by the marks on the way up to its top. If nothing
    would stay, what no mark lowers does, and if there is no such text, the branch with the most text.
    """
    page = parsed(html)
    marks, peaks = marks_of(page), {}
    blocks, scores, order = blocks_of(page), importances(page, tree, marks), list(_walk(page.root))
    for node in reversed(order):
        peaks[id(node)] = marks[id(node)] * max([scores[id(node)] if node.tag not in INLINE else 0.0, *(peaks[id(c)] for c in node.children if not c.out)])
    _gone(order, lambda node: node.tag not in INLINE and peaks[id(node)] < LOW)
    kept = [t for node, t in blocks if not node.gone]
    if not kept:
        _gone(order, lambda node: marks[id(node)] < 1)
        kept = [t for node, t in blocks if not node.gone]
    if not kept and blocks:
        node = page.root
        while (heavy := max((c for c in node.children if not c.out), key=lambda c: c.size, default=None)) and 2 * heavy.size > node.size:
            node = heavy
        inside = set(map(id, _walk(node)))
        kept = [t for n, t in blocks if id(n) in inside]
    return " ".join(kept)


def host_of(url: str) -> Column:
    """The host of a URL column in lower case, without user and port; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, pages, shown, said, marked): the nodes of every host's tree.

    Pages of a host with equal texts count once. Counts by (host, node, feature) come first, so that a host with
    a third of all pages is spread over its features; their entropies are sums of counts. A host's own figures
    are averaged with those of the same path elsewhere, by the number of pages that speak for each: the mean of
    all hosts' trees, or what one tree of all pages says of a path's texts if that is less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parsed(html)
                whole = xxhash.xxh3_64_intdigest("\n".join("".join(t for _, t in b) for b in page.blocks)) >> 1
                rows += [(host, *f, whole) for f in features(page)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "path", "kind", "feature", "marked", "whole"])

    seen = pages.select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "host string, path long, kind long, feature long, marked boolean, whole long")
    scratch = Scratch(pages.sparkSession, "trees")
    counted = scratch.keep(seen.groupBy("host", "path", "kind", "feature").agg(F.countDistinct("whole").alias("n"), F.max("marked").alias("marked")))
    own = scratch.keep(_entropies(counted, "host", "path"))
    weight = F.least(F.col("pages") - 1, F.lit(ONE_HOST))
    start = lambda x: F.when(x, MARKED_START).otherwise(START)
    begun = lambda said, n, marked: (said + start(marked) * F.when(marked, MARKED).otherwise(1.0)) / (n + start(marked))
    mean = lambda x: begun(F.sum(weight * F.col(x)), F.sum(weight), F.max("marked"))
    others = own.groupBy("path").agg(mean("shown").alias("shown_there"), mean("said").alias("said_on_hosts"))
    one = _entropies(counted.groupBy("path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("marked").alias("marked")), "path")
    merged = one.select("path", begun((F.col("pages") - 1) * F.col("said"), F.col("pages") - 1, F.col("marked")).alias("said_merged"))
    there = others.join(merged, "path").select("path", "shown_there", F.least("said_on_hosts", "said_merged").alias("said_there"))
    both = lambda x: (((F.col("pages") - 1) * F.col(x) + SHARED * F.col(f"{x}_there")) / (F.col("pages") - 1 + SHARED)).alias(x)
    return own.join(there, "path").select("host", "path", "pages", both("shown"), both("said"), "marked")


def _entropies(counted: DataFrame, *key: str) -> DataFrame:
    nodes = counted.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("spread"),
        F.sum(F.when(F.col("kind") == 1, F.log("n"))).alias("common"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("texts"),
        F.max("marked").alias("marked"),
    )
    m = F.greatest(F.col("pages"), F.lit(2)).cast("double")
    shown = F.when(F.col("pages") <= 1, 1.0).otherwise((F.log(m) - F.col("spread") / m) / F.log(m))
    said = F.when((F.col("pages") <= 1) | (F.col("texts") == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("common") / F.col("texts") / F.log(m)))
    return nodes.select(*key, F.greatest("pages", F.lit(1)).alias("pages"), F.coalesce(shown, F.lit(1.0)).alias("shown"), said.alias("said"), "marked")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A null page has an empty text; pages without a host share one tree. Rows that share an id are pages of their
    own, equal rows have equal texts, and other columns than page_id, url and html are not read. A page is parsed
    as a whole, whatever its length. An empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    #: Only what differs from the start need travel: the layouts of a site, not its pages.
    differs = lambda x: F.abs(F.col(x) - F.when(F.col("marked"), MARKED).otherwise(1.0)) > 1e-9
    node = F.concat(*(F.to_binary(F.lpad(F.hex(F.floor(x).cast("long")), 16, "0"), F.lit("hex")) for x in (F.col("path"), F.col("shown") * 1e9, F.col("said") * 1e9)))
    trees = scratch.keep(style_trees(pages).where(differs("said") | differs("shown")).groupBy("host").agg(F.collect_list(node).alias("nodes")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))

    #: A host's pages are dealt to one block for every PAGES of them, and each block gets the tree once, before its pages.
    blocks = scratch.keep(rows.groupBy("host").agg(F.ceil(F.count("*") / PAGES).cast("int").alias("blocks")))
    first = trees.join(blocks, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "nodes")
    few = blocks.where("blocks > 1").select(F.col("host").alias("of"), "blocks")
    dealt = rows.join(few, F.col("host") == F.col("of"), "left").withColumn("block", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("blocks", F.lit(1))).cast("int"))
    both = dealt.select("host", "block", F.lit(1).alias("turn"), "page_id", "url", "html", F.lit(None).cast("array<binary>").alias("nodes")).unionByName(
        first.select("host", "block", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "nodes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, {}
        for batch in slices(batches, "html"):
            ids, urls, texts = [], [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("host", "block", "turn", "page_id", "url")), strict=True)
            for i, (host, block, turn, page_id, url) in enumerate(keys):
                if (host, block) != at:
                    at, tree = (host, block), {}
                if not turn:
                    tree = unpacked(batch.column("nodes")[i].as_py())
                    continue
                ids.append(page_id)
                urls.append(url)
                texts.append(main_text(batch.column("html")[i].as_py(), tree))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.repartition("host", "block").sortWithinPartitions("host", "block", "turn").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def unpacked(nodes: list[bytes]) -> Tree:
    """{path: (shown, said)} of packed nodes."""
    rows = np.frombuffer(b"".join(nodes), dtype=">i8").reshape(-1, 3)
    return dict(zip(rows[:, 0].tolist(), zip((rows[:, 1] / 1e9).tolist(), (rows[:, 2] / 1e9).tolist(), strict=True), strict=True))
