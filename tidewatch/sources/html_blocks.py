"""B1: pages -> one row each with its text and its elements, the single distributed HTML parse.

`mapInPandas` runs the standard-library HTML tokenizer over each Arrow batch of pages. Tree rules: a start tag opens an
element (void elements never do), `<x/>` opens and closes one, an end tag closes the nearest open element of that name
and everything opened after it, a stray end tag is ignored, and nothing is closed implicitly. The page title is read
before script/style/noscript subtrees are dropped; these and comments are part of no element.

A page's text is stored once. An element is an interval of it (`start`, `stop`, in characters) and of the elements'
order (`ord`, and `until`, the last element inside it), so nesting costs a few numbers and no copy of the text, and
every element is there, however long. What page operators need of it is cut out by native expressions (operators/pages).
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

PAGE_SCHEMA = ("page_id long, title string, text string, elements array<struct<ord: int, until: int, tag: string, "
               "classes: array<string>, start: int, stop: int>>")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr", "basefont", "bgsound", "frame", "keygen", "menuitem", "spacer"}
_REMOVED = {"script", "style", "noscript"}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.elements: list[dict] = []
        self.strings: list[str] = []
        self.at = 0  # length of the text so far
        self.title = None

    def handle_starttag(self, tag, attrs):
        if self.open:
            self.open[-1]["kids"] += 1
        if tag in _VOID:
            return
        removed = tag in _REMOVED or bool(self.open) and self.open[-1]["removed"]
        classes = next((v.split() for k, v in reversed(attrs) if k == "class" and v), [])
        e = {"tag": tag, "classes": classes, "removed": removed, "kids": 0, "string": None, "start": self.at, "ord": len(self.elements)}
        self.open.append(e)
        self.elements.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(self.open.pop())

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                while len(self.open) > i:
                    self._close(self.open.pop())
                return

    def handle_data(self, data):
        if not self.open:
            return
        top = self.open[-1]
        top["kids"] += 1
        top["string"] = data
        if not top["removed"]:
            self.strings.append(data)
            self.at += len(data)

    def _close(self, e):
        e["stop"], e["until"] = self.at, len(self.elements) - 1
        if e["tag"] == "title" and self.title is None:
            # a title of several parts has no string of its own
            self.title = e["string"] if e["kids"] == 1 and e["string"] is not None else ""

    def finish(self):
        self.close()
        while self.open:
            self._close(self.open.pop())


def parse_page(html: str | None):
    """(title, text, elements) of a page."""
    b = _Builder()
    b.feed(html or "")
    b.finish()
    kept = [{k: e[k] for k in ("ord", "until", "tag", "classes", "start", "stop")} for e in b.elements if not e["removed"]]
    return b.title or "", "".join(b.strings), kept


PAGES_PER_FRAME = 256


def _parse(batches):
    for pdf in batches:
        for a in range(0, len(pdf), PAGES_PER_FRAME):
            part = pdf.iloc[a:a + PAGES_PER_FRAME]
            rows = [parse_page(html) for html in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"].to_list(), "title": [r[0] for r in rows],
                                "text": [r[1] for r in rows], "elements": [r[2] for r in rows]})


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """B1: (page_id, title, text, elements) of every page.

    Parsing costs far more than reading: a table that comes in fewer partitions than there are cores is dealt out first.
    """
    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].alias("html"))
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < cores:
        src = src.repartition(cores)
    return src.mapInPandas(_parse, PAGE_SCHEMA)
