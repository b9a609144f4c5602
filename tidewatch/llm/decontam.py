"""Benchmark decontamination: one Aho-Corasick automaton over normalised test windows.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Every
run of `window` consecutive item words is a pattern (an item with fewer words is one pattern). The
automaton is built once per Python worker, and each document is scanned once. Normalisation keeps
one byte per byte, so word offsets map straight back to byte offsets of the original text.

The pattern list is a stated query set (the benchmark), broadcast in blocks of a checked size: a
benchmark beyond `block_bytes` is scanned block by block and the hits of the blocks are united,
so no block grows with the benchmark and none with the documents.

Defined results: null texts have no words; an item without words matches nothing; items that share
a window are all reported; rows of the benchmark with the same item_id count as one item; a null
item_id still marks words but is not named; repeated documents are judged one by one; an empty
benchmark leaves every document clean. Documents' extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import untouched
from .worker import Same, held

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
BLOCK_BYTES = 16 << 20

# byte -> byte: A-Z lower-cased, separators to a blank, everything else kept (offsets stay)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD_BYTES = re.compile(rb"[^ ]+")

_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>"
_COUNTED = "n_hit long, spans array<struct<start: long, stop: long>>"
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
])


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window of the items: (pattern, n words, ids of its items)."""
    t = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    rows = items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("p"))
    return (rows.groupBy(F.array_join("p", " ").alias("pattern"), F.size("p").alias("n"))
            .agg(F.sort_array(F.collect_set("item")).alias("items")))


def pattern_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[list]:
    """The distinct windows as lists of at most `block_bytes` of text, one block on the driver at a time."""
    wins = windows_of(items, window)
    block, size = [], 0
    for r in wins.toLocalIterator():
        block.append((r["pattern"], r["n"], list(r["items"])))
        size += len(r["pattern"]) + 16 * len(r["items"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _automaton(patterns):
    """The automaton of a broadcast block, built once in a worker."""
    def build():
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, (p, n, _) in enumerate(patterns):
            a.add_word(f" {p.encode().decode('latin-1')} ", (k, n))
        if patterns:
            a.make_automaton()
        return a

    return held(Same("patterns", patterns), build)


def scan_text(text: str | None, automaton, patterns) -> dict:
    """Words, hit words, item ids and hit byte spans (of the original UTF-8 text) of one document."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    words = raw.split()
    out = {"n_words": len(words), "n_hit": 0, "items": [], "spans": []}
    if not words or not patterns:
        return out
    norm = b" ".join((b"", *words, b"")).decode("latin-1")
    found = [(end, *v) for end, v in automaton.iter(norm)]
    if not found:
        return out
    at, stop = {}, 0  # end offset in norm -> index of the word that ends there
    for k, w in enumerate(words):
        stop += len(w) + 1
        at[stop] = k
    hit, items = set(), set()
    for end, k, n in found:
        last = at[end]
        hit.update(range(last - n + 1, last + 1))
        items.update(x for x in patterns[k][2] if x is not None)
    spans, where = [], [m.span() for m in _WORD_BYTES.finditer(raw)]
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1]["stop"] = where[k][1]
        else:
            spans.append({"start": where[k][0], "stop": where[k][1]})
    return out | {"n_hit": len(hit), "items": sorted(items), "spans": spans}


def _scanner(patterns_b):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = patterns_b.value
        automaton = _automaton(patterns)
        for texts in batches:
            yield pa.array([scan_text(x.as_py(), automaton, patterns) for x in texts], _ARROW)

    return F.arrow_udf(scan, _RESULT).asNondeterministic()  # a filter on the result must not run it twice


def _union(a, b):
    """Unite the results of two blocks on the same text: spans and items are merged, words recounted."""
    return F.struct(
        a["n_words"].alias("n_words"), (a["n_hit"] + b["n_hit"]).alias("n_hit"),
        F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        F.concat(a["spans"], b["spans"]).alias("spans"))


def _recount(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Hit words and merged spans, once several blocks have marked spans of the same text."""
    out = []
    for t, found in zip(texts, spans.to_pylist()):
        merged = []
        for s in sorted((x["start"], x["stop"]) for x in found):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        n = 0
        if merged:
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE)
            n = sum(len(raw[a:b].split()) for a, b in merged)
        out.append({"n_hit": n, "spans": [{"start": a, "stop": b} for a, b in merged]})
    return pa.array(out, pa.struct([("n_hit", pa.int64()), ("spans", _ARROW.field("spans").type)]))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add `scan` (n_words, n_hit, items, spans) to every document; no shuffle of documents."""
    sc = docs.sparkSession.sparkContext
    blocks = pattern_blocks(items, window, block_bytes)
    df, many = docs, 0
    for block in blocks:
        found = _scanner(sc.broadcast(block))(F.col("text"))
        df = df.withColumn("scan" if not many else "_more", found)
        if many:
            df = df.withColumn("scan", _union(F.col("scan"), F.col("_more"))).drop("_more")
        many += 1
    if not many:
        return df.withColumn("scan", _scanner(sc.broadcast([]))(F.col("text")))
    if many > 1:
        df = df.withColumn("_r", F.arrow_udf(_recount, _COUNTED)(F.col("text"), F.col("scan.spans")))
        df = df.withColumn("scan", F.struct(F.col("scan.n_words"), F.col("_r.n_hit"), F.col("scan.items"),
                                            F.col("_r.spans"))).drop("_r")
    return df


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Documents in which no window of any item occurs, as they are."""
    return untouched(docs, ("scan", "_more", "_r"), lambda rows: scan(rows, items, **kw).where(F.col("scan.n_hit") == 0))


def items_digest(ids) -> str:
    """SHA-256 of the sorted, comma-joined ids (tests)."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
