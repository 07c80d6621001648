"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of presentation nodes: a node is the chain of element names and classes
that leads to it.  A content node is important where its texts differ from page to page and unimportant where the same
few recur (one minus the mean normalised entropy of its texts); a presentation node also counts how far the layout
below it differs.  Branches of low importance, against the tree they hang in, are removed from every page of the host,
and so are the elements whose name or role says that they are not the article.

A class or id that says so is only a hint.  It counts for nothing on an element that holds the article, the page's
first heading or most of its text; any other hinted element hangs in a tree of its own and is left out unless the
host's pages show that its texts are important.

The tree is never built in one place: pages emit their nodes and text digests, and the entropies are sums over groups
of (host, node, digest), combined before they are shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .common import map_batches
from .url_filter import url_parts

#: A branch is dropped below this importance, if it is also below ``RELATIVE`` times that of its tree, and stands on at
#: least ``LEAST_PAGES`` pages.
THRESHOLD, RELATIVE, LEAST_PAGES = 0.6, 0.6, 5
HINTED = 0.8  # importance from which a hinted element stays
GAMMA = 0.9  # weight of the contents against the layout of a node

# Element names of HTML and words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s "
                   "samp small span strike strong sub sup time tt u var wbr nobr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())  # no elements inside
TO_THE_END = frozenset(("script", "style", "xmp"))  # without an end tag they hide the rest of the page
EMBEDDED = frozenset("template svg select object video audio canvas annotation annotation-xml".split())  # noise, if ended
MATH = frozenset("math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle "
                 "mtable mtr mtd mfenced menclose mpadded mphantom mmultiscripts semantics".split())  # part of the line
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement banner "
    "promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup comment comments disqus respond replies share sharing social related recommended "
    "breadcrumb breadcrumbs widget login search form toolbar pagination pager skip".split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section main body html".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)
    |(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?>[^>"']++|"[^"]{0,20000}+"|'[^']{0,20000}+')*+|[^>]*+)(?:>|\Z))""",
                 re.X | re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "node", "noise", "main", "children", "hint", "under", "holds", "chars", "foreign", "parent")

    def __init__(self, tag: str, node: int, noise: bool, main: int, hint: bool = False, under: bool = False, parent=None):
        self.tag, self.node, self.noise, self.main, self.children, self.parent = tag, node, noise, main, [], parent
        self.hint, self.under = hint, under  # by class or id; itself or an element around it
        self.holds: set[str] = set()  # which of article, main and h1
        self.chars = 0  # of text that is not noise
        self.foreign = False  # within svg, where a slash ends an element


def _node(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def tags(source: str) -> list[tuple[str, str, bool, str]]:
    """(text before, name, end, attributes) of every tag, with an empty name for comments and the end of the page."""
    found, without_end, at = [], set(), 0
    while tag := TAG.search(source, at):
        name = (tag["name"] or "").lower()
        found.append((source[at:tag.start()], name, bool(tag["end"]), tag["attrs"] or ""))
        at = tag.end()
        if name in RAW and not tag["end"] and name not in without_end:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*+(?:>|\\Z)", re.I).search(source, at)
            if end:
                at = end.end()
            elif name in TO_THE_END:
                return found
            else:
                without_end.add(name)
    return [*found, (source[at:], "", False, "")]


class Page:
    """One page read once, front to back: ``blocks`` is a list of (text, innermost element) in page order.

    Elements link to their parent, so a page costs what it is long however deep it nests.
    """

    def __init__(self, source: str):
        self.root = Element("#page", 0, False, 0)
        self.stack = [self.root]
        self.blocks: list[tuple[str, Element]] = []
        self.open_tags: Counter[str] = Counter()
        self.closed: list[Element] = []
        self.mains: list[Element] = []
        parts: list[str] = []
        found = tags(source)
        waiting: dict[str, list[int]] = {name: [] for name in EMBEDDED}
        ended = set()  # places of embedded elements that have an end tag
        for i, (_, name, end, attrs) in enumerate(found):
            if name in EMBEDDED:
                if not end and not (name == "svg" and attrs.endswith("/")):
                    waiting[name].append(i)
                elif end and waiting[name]:
                    ended.add(waiting[name].pop())
        for i, (text, name, end, attrs) in enumerate(found):
            parts.append(text)
            if not name or name in INLINE:
                continue
            if name == "br" or name in MATH:
                parts.append(" " if name in ("br", "mtr", "mtd") else "")
                continue
            self._flush(parts)
            if name in VOID or name in RAW and not end:
                continue
            if end:
                self._close(name)
            elif name in EMBEDDED and i not in ended or attrs.endswith("/") and self.stack[-1].foreign:
                continue
            elif not attrs.endswith("/") or name not in ("p", "div"):
                self._open(name, attrs)
        self._flush(parts)
        self._shut(1)

    def _flush(self, parts: list[str]) -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                self.blocks.append((text, self.stack[-1]))
                if not self.stack[-1].noise:
                    self.stack[-1].chars += len(text)

    def _open(self, name: str, attrs: str) -> None:
        shut = CLOSES.get(name, ())
        if self.stack[-1].tag == "p" and name not in EMBEDDED:
            self._shut(len(self.stack) - 1)
        for depth in range(len(self.stack) - 1, 0, -1) if any(self.open_tags[tag] for tag in shut) else ():
            tag = self.stack[depth].tag
            if tag in shut:
                self._shut(depth)
                break
            if tag in SCOPE:
                break
        values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)} if attrs else {}
        words = set(WORDS.findall(f"{values.get('class', '')} {values.get('id', '')}".lower()))
        parent = self.stack[-1]
        main = parent.main
        noise = (parent.noise or name in NOISE_TAGS or name in EMBEDDED or values.get("role", "").lower() in ROLES
                 or name == "header" and not main)
        hint = bool(words & NOISE_WORDS) and name not in ("html", "body")
        label = ".".join([name, *sorted(values.get("class", "").lower().split())[:3]])
        if len(self.stack) > 200:  # deeper elements count as their ancestor at this depth
            label, node = "", parent.node
        else:
            node = _node(parent.node, label)
        element = Element(name, node, noise, main, hint, hint or parent.under, parent)
        element.foreign = name == "svg" or parent.foreign
        parent.children.append(name)
        self.stack.append(element)
        self.open_tags[name] += 1
        if name in MAIN_TAGS and not noise:
            element.main = main or node
            self.mains.append(element)
        if (name in MAIN_TAGS or name == "h1") and not noise:
            for outer in reversed(self.stack):
                if name in outer.holds:
                    break
                outer.holds.add(name)

    def _close(self, name: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1) if self.open_tags[name] else ():
            if self.stack[depth].tag == name:
                self._shut(depth)
                return

    def _shut(self, depth: int) -> None:
        """Close the elements from ``depth`` on; what they hold counts for the element around them."""
        self.closed += self.stack[depth:]
        for element in reversed(self.stack[depth:]):
            element.parent.chars += element.chars
            self.open_tags[element.tag] -= 1
        del self.stack[depth:]

    def body(self) -> int:
        return _node(_node(0, "html"), "body")

    def content(self) -> Iterator[tuple[str, int, tuple[int, ...], int]]:
        """(text, top, nodes, hinted) of blocks that no element's name rules out; where a page marks its article, only
        what is inside.

        ``top`` is the tree a block hangs in (its article, else the body), ``nodes`` lead to the block below it.  What
        a hint speaks against has its outermost such element as ``hinted`` and hangs in that one's tree; else it is 0.
        """
        marked = any(not e.under for e in self.mains)

        def article(e: Element) -> bool:  # an article under a hint counts if it is plainly the page's
            return not e.under or "main" in e.holds or "h1" in e.holds or 2 * e.chars > self.root.chars

        def ruled_out(e: Element) -> bool:
            return e.hint and not ("main" in e.holds or "h1" in e.holds or 2 * e.chars > self.root.chars
                                   or "article" in e.holds and not marked)

        tops = {id(e) for e in self.mains if article(e)}
        # of every element, the outermost article and the outermost ruled-out element around it, outer ones first
        top_of: dict[int, Element | None] = {id(self.root): None}
        out_of: dict[int, Element | None] = {id(self.root): None}
        paths: dict[tuple[int, int], tuple[int, ...]] = {}

        def know(element: Element) -> None:
            todo = []
            while id(element) not in top_of:
                todo.append(element)
                element = element.parent
            for e in reversed(todo):
                top_of[id(e)] = top_of[id(e.parent)] or (e if id(e) in tops else None)
                out_of[id(e)] = out_of[id(e.parent)] or (e if ruled_out(e) else None)

        def path(element: Element, above: Element) -> tuple[int, ...]:
            """The nodes below ``above`` down to ``element``; elements that count as their ancestor add none."""
            todo, found = [], ()
            while element is not above:
                if (element.node, above.node) in paths:
                    found = paths[element.node, above.node]
                    break
                todo.append(element)
                element = element.parent
            for e in reversed(todo):
                if e.node != e.parent.node and not (above is self.root and e.tag in ("html", "body")):
                    found = (*found, e.node)
                paths[e.node, above.node] = found
            return found

        for text, last in self.blocks:
            if last.noise or last.tag in ("html", "head"):
                continue
            know(last)
            at = top_of[id(last)] if last.main else None
            if tops and at is None:
                continue
            out = out_of[id(last)] if last.under else None
            if out is not None:
                yield text, hinted_tree(out.node), path(last, out), out.node
            elif at is not None:
                yield text, at.node, path(last, at), 0
            else:
                yield text, 0, path(last, self.root), 0


def hinted_tree(node: int) -> int:
    return _node(node, "#hinted")


def main_text(source: str, removed: frozenset[int] | set[int] = frozenset(),
              kept: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks joined by one space, without the nodes in ``removed``; of hinted trees those in ``kept``."""
    return " ".join(text for text, top, nodes, hinted in Page(source).content()
                    if (not hinted or top in kept) and (not removed or removed.isdisjoint(nodes)))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, removed, kept): per host the nodes of low importance and the hinted trees of high, from pages (id, host, html)."""
    def make():
        def step(batch: pa.RecordBatch):
            out = {n: [] for n in ("host", "top", "nodes", "digest")}
            layout = {n: [] for n in ("host", "top", "nodes", "digest")}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source or "")
                seen = set()
                for text, top, nodes, _ in page.content():
                    seen.add((top, nodes, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1))
                for top, nodes, digest in seen:
                    for name, value in zip(out, (host, top, list(nodes), digest)):
                        out[name].append(value)
                for element in {e.node: e for e in page.closed if e.children and not e.noise}.values():
                    digest = xxhash.xxh64_intdigest(" ".join(dict.fromkeys(element.children)).encode()) >> 1
                    for name, value in zip(layout, (host, element.node, None, digest)):
                        layout[name].append(value)
            return {n: out[n] + layout[n] for n in out}
        return step

    seen = materialize(map_batches(pages.select("host", "html"), make,
                                   "host string, top bigint, nodes array<bigint>, digest bigint"), "site-nodes")
    each = (seen.filter(F.col("nodes").isNotNull()).groupBy("host", "top", "nodes", "digest")
            .agg(F.count("*").alias("c")))
    leaf = each.groupBy("host", "top", "nodes").agg(F.count("*").alias("texts"), F.sum(F.log("c")).alias("logs"),
                                                    F.max("c").alias("most"), F.sum("c").alias("uses"))
    # pages that have the node: every page of the tree at most, and at least as many as the commonest text
    count = seen.filter(F.col("nodes").isNull()).groupBy("host", "top", "digest").agg(F.count("*").alias("c"))
    layout = count.groupBy("host", F.col("top").alias("node")).agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clog"))
    layout = materialize(layout.withColumn("layout", F.when(F.col("m") > 1, 1 - F.col("clog") / F.col("m") / F.log("m"))
                                           .otherwise(1.0)), "site-layout")
    leaf = materialize(leaf, "site-leaves")
    pages_of = pages.groupBy("host").agg(F.count("*").alias("pages"))
    leaf = leaf.join(materialize(pages_of, "site-pages"), "host")
    m = F.least(F.col("pages"), F.col("uses"))
    importance = F.when(m > 1, F.col("texts") - F.col("logs") / F.log(m)).otherwise(F.col("texts").cast("double"))
    scored = leaf.withColumn("important", importance).withColumn("m", m)
    branch = (scored.withColumn("node", F.explode(F.concat("nodes", F.array(F.lit(0).cast("bigint")))))
              .groupBy("host", "top", "node")
              .agg((F.sum("important") / F.sum("texts")).alias("content"), F.sum("m").alias("m")))
    branch = materialize(branch, "site-branches")
    tree = branch.filter("node = 0").select("host", "top", F.col("content").alias("whole"))
    judged = (branch.filter("node <> 0").join(tree, ["host", "top"])
              .join(layout.select("host", "node", "layout"), ["host", "node"], "left")
              .withColumn("composite", F.coalesce((1 - GAMMA) * F.col("layout") + GAMMA * F.col("content"), "content")))
    low = judged.filter((F.col("composite") < THRESHOLD) & (F.col("composite") < RELATIVE * F.col("whole"))
                        & (F.col("m") >= LEAST_PAGES)).select("host", F.col("node").alias("low"), F.lit(None).cast("bigint").alias("high"))
    # only a hinted tree is asked for by its top
    high = branch.filter((F.col("node") == 0) & (F.col("top") != 0) & (F.col("content") >= HINTED)
                         & (F.col("m") >= LEAST_PAGES)).select("host", F.lit(None).cast("bigint").alias("low"), F.col("top").alias("high"))
    return low.unionByName(high).groupBy("host").agg(F.collect_set("low").alias("removed"), F.collect_set("high").alias("kept"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; null or empty html has an empty text, a null url the host "".

    Repeated rows and null ids are kept as they are; an empty table gives an empty result.
    """
    host, _ = url_parts(F.col(url_col))
    rows = spread(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"),
                               F.col(html_col).alias("html")))
    trees = materialize(style_trees(rows), "site-trees")
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch):
            texts = [main_text(source or "", frozenset(removed or ()), frozenset(kept or ())) for source, removed, kept in
                     zip(*(batch.column(n).to_pylist() for n in ("html", "removed", "kept")))]
            return {"id": batch.column("id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}
        return step

    joined = rows.join(trees, "host", "left").select("id", "url", "html", "removed", "kept")
    return (map_batches(joined, make, f"id {kind}, url string, text string, n_chars bigint")
            .withColumnsRenamed({"id": id_col, "url": url_col}))
