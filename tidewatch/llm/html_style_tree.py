"""Main text of web pages with a site style tree per host.

Pass 1 parses every page into a DOM of the parts that may hold content and emits its *style nodes*:
a node is the path from the root of tags and class words without digits (html, body, article and main by their
tag alone), so the DOMs of a host merge where their paths agree, whatever ids, numbers or page names the
classes carry. For every node of a host, over its distinct pages:

- content importance of a block: 1 - mean over its distinct texts of log(pages with the text) / log(pages + SMOOTH);
  a text that every page repeats weighs about 0 (the less so, the fewer the pages), a text of one page 1;
- presentation importance of an element: the entropy (base: pages) of its pages' child sequences;
- composite importance: (1 - GAMMA^l) * presentation + GAMMA^l * mean content importance of the
  blocks below it, for l children on average.

Every node that two pages or more share is judged alike, on hosts of any size: under `THRESHOLD` it is low. Pass 2
parses each page again and leaves out the branches that are low on its host; if nothing at all remained,
the page keeps them (a host that serves one text everywhere).

Many navigation bars, adverts and footers differ from page to page, so entropy alone cannot tell them from
content: branches whose tag, role, class or id names such a part are left out in both passes, however long they
are, unless they hold the page's <main>, or its article (no article stands outside of such branches, or
shorter ones only; in comments none does). An article or main that is named a comment is one. A form that holds
most of the text of a page without article or main is the page's frame. If nothing else is there, the
branch with most of the text stays, or all of them. Where <article> and <main> hold most of the remaining
text, content is looked for there only.

Statistics are aggregated partially before each shuffle (a host may hold a third of all pages).
Only node hashes travel; a page's list of low nodes is bounded by its own DOM.

Defined results: a null page has text ""; a null url belongs to the host ""; equal pages of a host
count once in the statistics; a page without blocks is ""; markup that never closes ends with the
page; other columns pass through, a column of a result's name is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

GAMMA = 0.9
SMOOTH = 0.25  # added to a node's pages, so that a text on both of two pages weighs 0.15
THRESHOLD = 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style noscript template title button select option textarea iframe object svg canvas audio video map "
    "datalist".split())
PARTS = frozenset("nav menu aside footer form dialog".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody "
    "tfoot tr figure figcaption header address details summary hr center fieldset".split()) | PARTS
CLOSES_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side footer foot masthead topbar cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "disqus reply replies respond widget toolbar pagination pager legal copyright disclaimer hidden".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(1 << 14)
def _names(text: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _NAME.findall(text))


def _words(attrs: dict) -> frozenset[str]:
    """The words of an element's classes and id."""
    if "class" not in attrs and "id" not in attrs:
        return frozenset()
    return _names(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")


@lru_cache(1 << 14)
def _classes(text: str) -> str:
    return ".".join(sorted({re.sub(r"\d+", "", c) for c in text.split()}))


def _style(tag: str, attrs: dict) -> str:
    """What an element is called in paths: its tag and classes, without numbers."""
    if tag in ("html", "body", *MAIN) or not attrs.get("class"):
        return tag
    return f"{tag}.{_classes(attrs['class'])}"


def _named(tag: str, attrs: dict, in_main: bool) -> bool:
    """A part that is rarely the page's text, by its tag, role, class, id or a mark that hides it."""
    if tag in PARTS or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if (attrs.get("role") or "").strip().lower() in ROLES or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
        return True
    if tag in ("html", "body"):
        return False
    if tag == "header" and not in_main:
        return True
    names = _words(attrs)
    if tag in MAIN:
        return bool(names & COMMENTS)
    return bool(names & NAMES) or (not in_main and "header" in names)


class Page(HTMLParser):
    """One page: its blocks (node, text) in order and its elements' child sequences.

    Memory is the page's own size; nodes are hashes of their paths.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        # tag, node, is it dropped (or inside), named branches it is in, is it the page's article or main
        self.open: list[tuple[str, int, bool, tuple, bool]] = []
        self.n_main = 0
        self.blocks: list[tuple[int, list, bool, tuple]] = []  # node, parts, inside of article or main, ancestors
        self.children: dict[int, list[tuple[int, tuple]]] = {}
        self.branches: list[dict] = []  # named branches: kind, and whether they hold an article or a main
        self.free_main = False  # an article or main stands outside of them
        self.parts: list[tuple[str, tuple]] = []  # text, named branches it is in
        self.feed(html)
        self.close()
        self._flush()
        self.out = self._cut()

    def _flush(self) -> None:
        parts, self.parts = self.parts, []
        if any(data != " " for data, _ in parts):
            nodes = tuple(o[1] for o in self.open)
            at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] in BLOCKS), -1)
            self.blocks.append((nodes[at] if at >= 0 else 0, parts, self.n_main > 0, nodes[:at + 1]))

    def _pop(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        if any(o[0] in BLOCKS for o in self.open[k:]):
            self._flush()
        self.n_main -= sum(o[4] for o in self.open[k:])
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        closes = {"p"} if tag in CLOSES_P else CLOSED_BY.get(tag, ())
        if closes:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in closes:
                    self._pop(k)
                    break
                if self.open[k][0] in BLOCKS and self.open[k][0] != "p" or self.open[k][0] in ("td", "th"):
                    break
        if tag in BLOCKS:
            self._flush()
        elif tag in ("br", "td", "th", "img"):
            self.parts.append((" ", ()))
        if tag in VOID:
            return
        attrs = dict(attrs)
        _, parent, dropped, named, _ = self.open[-1] if self.open else ("", 0, False, (), False)
        dropped = dropped or tag in DROPPED
        is_named = not dropped and _named(tag, attrs, self.n_main > 0)
        is_main = tag in MAIN and not dropped and not is_named
        if is_main:
            self.free_main = self.free_main or not named
            for k in named:
                self.branches[k][tag] = True
        if is_named:
            named = (*named, len(self.branches))
            kind = "comments" if _words(attrs) & COMMENTS else "form" if tag == "form" else ""
            self.branches.append({"kind": kind, "article": False, "main": False})
        node = hash_of(f"{parent}>{_style(tag, attrs)}")
        if not dropped:
            self.children.setdefault(parent, []).append((node, named))
        self.open.append((tag, node, dropped, named, is_main))
        self.n_main += is_main

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as in browsers: the slash says nothing, void elements have no end

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data):
        if not self.open:
            self.parts.append((data, ()))
        elif not self.open[-1][2]:
            self.parts.append((data, self.open[-1][3]))

    def _cut(self) -> set[int]:
        """The named branches to leave out (see above)."""
        if not self.branches:
            return set()
        total, free, chars = 0, 0, [0] * len(self.branches)
        for _, parts, inside, _ in self.blocks:
            for data, named in parts:
                n = sum(map(len, data.split()))
                total += n
                free += n * (inside and not named)
                for k in named:
                    chars[k] += n
        any_main = self.free_main or any(b["article"] or b["main"] for b in self.branches)

        def stays(k: int) -> bool:
            b = self.branches[k]
            if b["kind"] == "comments":
                return (b["article"] or b["main"]) and not self.free_main
            if b["kind"] == "form" and not any_main:
                return 2 * chars[k] > total
            return b["main"] or b["article"] and (not self.free_main or chars[k] > free)

        out = {k for k in range(len(self.branches)) if not stays(k)}
        for less in (out, {k for k in out if 2 * chars[k] <= total}):
            if any(data.strip() and not less.intersection(named) for _, parts, _, _ in self.blocks for data, named in parts):
                return less
        return set()

    def kids(self, node: int) -> list[int]:
        """An element's children without the branches left out."""
        return [k for k, named in self.children.get(node, ()) if not self.out.intersection(named)]

    def content(self) -> list[tuple[int, str, tuple]]:
        """Blocks without the named branches, and of article and main only where these hold most of them: node, text,
        nodes above and itself."""
        blocks = [(n, " ".join("".join(d for d, named in parts if not self.out.intersection(named)).split()), inside, up)
                  for n, parts, inside, up in self.blocks]
        blocks = [b for b in blocks if b[1]]
        main = 2 * sum(len(b[1]) for b in blocks if b[2]) > sum(len(b[1]) for b in blocks)
        return [(n, t, up) for n, t, inside, up in blocks if inside or not main]


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(html: str | None, low=frozenset()) -> str:
    """The page's text without its low branches (with them, if nothing else is there)."""
    blocks = Page(html or "").content()
    kept = [t for _, t, up in blocks if not low.intersection(up)] if low else []
    return "\n".join(kept or [t for _, t, _ in blocks])


_NODES = "page binary, host string, nodes array<struct<kind: tinyint, node: bigint, value: bigint, width: int>>"
_FIELDS = {"kind": pa.int8(), "node": pa.int64(), "value": pa.int64(), "width": pa.int32()}


def _style_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page with its style nodes: kind 0 a text of a block, 1 an element's child sequence, 2 a block below an element."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part, rows, ends = batch.slice(a, 64), [], [0]
            for html in part.column(2).to_pylist():
                dom, seen = Page(html or ""), set()
                for node, text, up in dom.content():
                    seen.add((0, node, hash_of(text), 0))
                    seen.update((2, above, node, 0) for above in up)
                for above in {s[1] for s in seen if s[0] == 2}:  # each element's children once
                    kids = dom.kids(above)
                    shape = [k for k, j in zip(kids, [None, *kids]) if k != j]  # repeats of a child are one
                    seen.add((1, above, hash_of(",".join(map(str, shape))), len(kids)))
                rows += sorted(seen)
                ends.append(len(rows))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _FIELDS.values())]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(_FIELDS)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), nodes], ["page", "host", "nodes"])


def importance(nodes: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, node, pages, importance) from the distinct style nodes of the pages."""
    counted = nodes.groupBy("host", "kind", "node", "value").agg(F.count("*").alias("n"), F.avg("width").alias("width"))
    texts, shapes, below = (counted.where(F.col("kind") == k) for k in (0, 1, 2))
    log = lambda c: F.log(c.cast("double"))
    of_pages = lambda c: F.log(c.cast("double") + SMOOTH)
    pages = shapes.groupBy("host", "node").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * log(F.col("n"))).alias("nlogn"),
        (F.sum(F.col("n") * F.col("width")) / F.sum("n")).alias("l"))
    spread = F.when(F.col("pages") > 1, (log(F.col("pages")) - F.col("nlogn") / F.col("pages")) / log(F.col("pages"))).otherwise(F.lit(1.0))
    pages = pages.select("host", "node", "pages", "l", spread.alias("presentation"))
    content = texts.groupBy("host", "node").agg(F.avg(log(F.col("n"))).alias("mean")).join(pages.select("host", "node", "pages"), ["host", "node"])
    content = content.select("host", F.col("node").alias("value"), F.when(
        F.col("pages") > 1, 1 - F.col("mean") / of_pages(F.col("pages"))).otherwise(F.lit(1.0)).alias("content"))
    of_blocks = below.join(content, ["host", "value"]).groupBy("host", "node").agg(
        (F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("content"))
    weight = F.pow(F.lit(gamma), F.col("l"))
    return pages.join(of_blocks, ["host", "node"]).select(
        "host", "node", "pages", ((1 - weight) * F.col("presentation") + weight * F.col("content")).alias("importance"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add text (the page's main text) and n_chars to every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    host = host_of(F.col("url"))
    keyed = pages.drop("text", "n_chars").withColumns({
        "_host": host, "_page": F.unhex(F.md5(F.concat_ws("\n", host, html).cast("binary")))})
    nodes = keyed.select("_page", "_host", html.alias("html")).mapInArrow(_style_nodes, _NODES).dropDuplicates(["page"])
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/style-nodes-{uuid.uuid4().hex}"
    nodes.write.parquet(folder)  # compressed, unlike a checkpoint
    nodes = pages.sparkSession.read.schema(_NODES).parquet(folder).select("page", "host", F.inline("nodes"))
    low = importance(nodes).where((F.col("pages") > 1) & (F.col("importance") < threshold)).select("host", "node")
    cut = (nodes.where("kind = 1").join(low, ["host", "node"], "left_semi")
           .groupBy("page").agg(F.collect_set("node").alias("_low")).withColumnRenamed("page", "_page"))

    def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, lows in batches:
            yield pa.array([main_text(h, frozenset(n or ())) for h, n in zip(htmls.to_pylist(), lows.to_pylist())], pa.string())

    text = F.arrow_udf(texts, "string").asNondeterministic()(F.col("html"), F.col("_low"))
    out = keyed.join(cut.hint("shuffle_hash"), "_page", "left").withColumn("text", text)
    return out.drop("_page", "_host", "_low").withColumn("n_chars", F.length("text").cast("long"))
