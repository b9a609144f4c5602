"""Repeated byte strings: bytes covered by a string of `LENGTH` bytes that also starts anywhere else.

Column-wise multi-document construction, as dealt (insert one symbol per document each round and
update the collection's order and common prefixes), needs as many rounds over the whole collection
as the longest document has bytes. So it is applied to short anchored passages instead of whole texts:

1. Anchors. In every LENGTH-byte window the smallest hash of its Q-byte strings (the leftmost of
   equal ones) is the window's anchor; this depends on the window's bytes alone, so equal windows
   have equal anchors at the same place. Anchors that occur once in the corpus cannot lie in a
   repeated window and are dropped; only (hash, text, position) rows are shuffled for that.
2. Passages. Every text with remaining anchors gives, per anchor, the bytes of all windows that it
   anchors (at most 2 * LENGTH - Q bytes). Passages with one anchor hash are aligned at the anchor.
3. Rounds. A task takes a bounded block of passages and inserts one column each round, from right to
   left: a stable sort by the new symbol updates the order of the suffixes, and range minima
   update their common prefixes. Two windows are equal where the common prefix reaches LENGTH.
4. An anchor with more passages than a block holds is dealt over several blocks, by text and place; what a
   block found unique is compared with the other blocks by 128-bit hashes of the windows.

Copies of a whole text are one text with a count. Defined results: null and short texts lose
nothing; a repeated row (also with the same doc_id) counts as another document; strings never
cross texts, and overlapping repeats inside one text count; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .minhash import _powers, _tables

LENGTH = 400
Q = 64
BLOCK = 4096  # passages of a block
UNIT_BYTES = 1 << 20

_ANCHORS = "hash long, text_key string, pos int, low int, high int"
_PASSAGES = "text_key string, hash long, n long, left int, first int, passage binary"
_RUNS = "kind int, text_key string, first int, last int, window binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = Q):
    """Anchors of the texts that lie end to end in `raw`: (hash, position, first and last window start)."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_tables["byte"][raw] * up[:n], out=sums[1:])
    h = (sums[q:] - sums[:-q]) * down[:n - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    place = np.uint64((1 << 24) - 1)
    keys = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width = length - q + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(keys)] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    least = (np.minimum(behind[:m], ahead[width - 1:width - 1 + m]) & place).astype(np.int64)
    inside = np.ones(m, bool)  # windows that cross a text's end do not count
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1):e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = least[starts]
    new = np.append(True, (np.diff(least) != 0) | (np.diff(starts) != 1))
    at = np.flatnonzero(new)
    return h[least[at]].view(np.int64), least[at], starts[at], starts[np.append(at[1:], len(starts)) - 1]


def _groups(keys: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    part, size = ([], []), 0
    for k, t in zip(keys, texts):
        if part[0] and size + len(t) > UNIT_BYTES:
            yield part
            part, size = ([], []), 0
        part[0].append(k)
        part[1].append(t)
        size += len(t)
    if part[0]:
        yield part


def _text_anchors(text: bytes) -> tuple:
    """Anchors of one text of any length: long texts in pieces that overlap by a window less a byte."""
    found = []
    for a in range(0, max(len(text) - LENGTH + 1, 1), UNIT_BYTES):
        piece = np.frombuffer(text[a:a + UNIT_BYTES + LENGTH - 1], np.uint8)
        h, pos, low, high = anchors(piece, np.array([len(piece)]))
        found.append((h, pos + a, low + a, high + a))
    return tuple(np.concatenate(c) for c in zip(*found))


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())]
        for keys, group in _groups(batch.column(0).to_pylist(), texts):
            if len(group) == 1:
                h, pos, low, high = _text_anchors(group[0])
                owner, base = np.zeros(len(h), np.int64), np.zeros(1, np.int64)
            else:
                ends = np.cumsum([len(t) for t in group])
                h, pos, low, high = anchors(np.frombuffer(b"".join(group), np.uint8), ends)
                owner = np.searchsorted(ends, low, "right")
                base = np.append(0, ends[:-1])
            off = base[owner]
            yield pa.RecordBatch.from_pydict({
                "hash": pa.array(h), "text_key": pa.array(keys, pa.string()).take(pa.array(owner)),
                "pos": pa.array((pos - off).astype(np.int32)), "low": pa.array((low - off).astype(np.int32)),
                "high": pa.array((high - off).astype(np.int32))})


def _cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text, its anchors) -> one row per anchor with the bytes of its windows."""
    for batch in batches:
        for k in range(batch.num_rows):
            key, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py().encode("utf-8", "surrogatepass")
            found = batch.column(2)[k].values
            for a in range(0, len(found), BLOCK):  # a text of a short period has an anchor per period
                rows = found.slice(a, BLOCK).to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "text_key": pa.array([key] * len(rows), pa.string()),
                    "hash": pa.array([r["hash"] for r in rows], pa.int64()),
                    "n": pa.array([r["n"] for r in rows], pa.int64()),
                    "left": pa.array([r["pos"] - r["low"] for r in rows], pa.int32()),
                    "first": pa.array([r["low"] for r in rows], pa.int32()),
                    "passage": pa.array([text[r["low"]:r["high"] + LENGTH] for r in rows], pa.binary())})


def column_rounds(group: np.ndarray, left: np.ndarray, passages: list[bytes], length: int = LENGTH, q: int = Q):
    """Which windows of the passages are equal to a window of another passage of their group.

    Passages are aligned at their anchors (`left` bytes before it). Returns, for every column of
    window starts, a row of marks, the classes' first members (both by passage), and the columns'
    offset: column c of a passage is its window start c - (length - q) + left.
    """
    m, width = len(passages), 2 * (length - q) + q
    reach = length - q  # most bytes before an anchor
    size = np.fromiter(map(len, passages), np.int64, m)
    table = np.full((width, m), -1, np.int16)
    begin = reach - left
    flat = np.frombuffer(b"".join(passages), np.uint8)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    table[np.repeat(begin, size) + inside, np.repeat(np.arange(m), size)] = flat
    _, rank = np.unique(group, return_inverse=True)
    base = rank.astype(np.int64) * 512
    order = np.argsort(rank, kind="stable")
    prefix = np.zeros(m + 1, np.int32)  # common prefix with the one before; one more for the end
    marks, heads = np.zeros((reach + 1, m), bool), np.zeros((reach + 1, m), bool)
    for c in range(width - 1, -1, -1):
        symbol = table[c][order]
        key = base[order] + symbol
        at = np.argsort(key, kind="stable")  # where each one of the new order stood
        key = key[at]
        between = np.minimum.reduceat(prefix, at + 1)  # least prefix between neighbours of like symbols
        order = order[at]
        new = np.zeros(m + 1, np.int32)
        same = (key[1:] == key[:-1]) & (symbol[at][1:] >= 0)
        new[1:m][same] = np.minimum(between[:-1][same] + 1, length)
        prefix = new
        if c <= reach:
            full = prefix >= length
            marks[c, order] = full[:-1] | full[1:]
            heads[c, order] = full[1:] & ~full[:-1]
    return marks, heads, begin


def _block(table: pa.Table) -> pa.Table:
    """Repeated window starts of a block of passages, as runs; for anchors that are dealt over several
    blocks also the windows found unique here (kind 1) and one of each that is repeated here (kind 2)."""
    group = table.column("hash").to_numpy()
    left, first = table.column("left").to_numpy().astype(np.int64), table.column("first").to_numpy().astype(np.int64)
    split = table.column("split").to_numpy()
    passages, keys = table.column("passage").to_pylist(), table.column("text_key")
    marks, heads, begin = column_rounds(group, left, passages)
    padded = np.zeros((marks.shape[0] + 2, marks.shape[1]), np.int8)
    padded[1:-1] = marks
    step = np.diff(padded, axis=0).T  # by passage, then by column
    who, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    kinds, owners = [np.zeros(len(who), np.int32)], [who]
    lows, highs = [first[who] + a - begin[who]], [first[who] + b - 1 - begin[who]]
    windows: list = [None] * len(who)
    for kind, chosen in ((1, ~marks), (2, heads)) if split.any() else ():
        n = np.array([len(p) - LENGTH + 1 for p in passages])
        column = np.arange(marks.shape[0])[:, None]
        valid = (column >= begin) & (column < begin + n) & split
        who, c = np.nonzero((chosen & valid).T)
        at = c - begin[who]
        kinds.append(np.full(len(who), kind, np.int32))
        owners.append(who)
        lows.append(first[who] + at)
        highs.append(first[who] + at)
        windows += [hashlib.blake2b(passages[w][s:s + LENGTH], digest_size=16).digest() for w, s in zip(who.tolist(), at.tolist())]
    low, high = (np.concatenate(x).astype(np.int32) for x in (lows, highs))
    return pa.table({"kind": pa.array(np.concatenate(kinds)), "text_key": keys.take(pa.array(np.concatenate(owners))),
                     "first": pa.array(low), "last": pa.array(high), "window": pa.array(windows, pa.binary())})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copies, runs of repeated window starts) -> the digest of what is left."""
    for batch in batches:
        out = []
        for doc_id, text, copies, runs in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            spans = [(0, len(raw))] if copies > 1 and len(raw) >= LENGTH else kept_out(runs or [])
            left, at = hashlib.sha256(), 0
            for a, b in spans:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), left.hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names)


def kept_out(runs: list, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed byte spans of a text, from the runs of its repeated window starts."""
    spans: list = []
    for a, b in sorted((r["first"], r["last"] + length) for r in runs):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))
    copies = keyed.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))

    found = keyed.select("text_key", "text").mapInArrow(_find_anchors, _ANCHORS)
    often = found.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").select("hash")
    rows = cut_lineage(found.join(often.hint("shuffle_hash"), "hash").distinct())  # of distinct texts
    sizes = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    by_text = (rows.join(sizes, "hash").groupBy("text_key")
               .agg(F.collect_list(F.struct("hash", "pos", "low", "high", "n")).alias("anchors")))
    chosen = keyed.join(by_text.join(copies, "text_key").hint("shuffle_hash"), "text_key").where(
        F.col("doc_id").eqNullSafe(F.col("rep")))  # of equal texts one gives its passages
    passages = chosen.select("text_key", "text", "anchors").mapInArrow(_cut_passages, _PASSAGES)

    # whole anchors share blocks of about BLOCK passages; a frequent anchor is dealt over several blocks
    parts, buckets = F.ceil(F.col("n") / BLOCK).cast("int"), max(1, -(-2 * total // BLOCK))
    dealt = passages.withColumn("split", parts > 1).withColumns({
        "bucket": F.when(F.col("split"), F.col("hash")).otherwise(F.pmod("hash", F.lit(buckets))),
        "part": F.when(F.col("split"), F.pmod(F.xxhash64("text_key", "first"), parts).cast("int")).otherwise(F.lit(-1))})
    out = cut_lineage(dealt.drop("n").groupBy("bucket", "part").applyInArrow(_block, _RUNS))

    across = out.where("kind > 0")
    met = across.groupBy("window").agg(F.sum("kind").alias("w")).where("w > 1")
    runs = out.where("kind = 0").select("text_key", "first", "last").union(
        across.where("kind = 1").join(met, "window").select("text_key", "first", "last"))
    of_text = runs.groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    known = copies.join(of_text, "text_key", "left").select("text_key", "copies", "runs")
    full = keyed.join(known.hint("shuffle_hash"), "text_key", "left")
    return full.select("doc_id", "text", "copies", "runs").mapInArrow(_remove, _RESULT)
