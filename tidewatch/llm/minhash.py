"""MinHash near-duplicates with min-max hashing.

Each of `PERMUTATIONS` hash functions is evaluated once per shingle and gives two unbiased values,
its minimum and its maximum, so 64 evaluations make a signature of 128 values: 32 bands of 4. A pair
with a similarity of 0.75 shares no band with a probability of (1 - 0.75^4)^32, below 1 in 180,000.

1. Signatures: one Arrow pass over whole texts; shingles are exact 5-word sequences, hashed to 64 bits.
2. Documents with the same shingle set become one node (grouped by a 128-bit digest).
3. Nodes that share a band meet in a bucket. A bucket is never expanded into pairs: its most popular
   member (the one whose bands are shared most) leads, and every other member is compared with it on
   full shingle sets; members of like components need no further test. Buckets that still span
   several components compare with further leaders, and what is left is compared in blocks inside
   tasks, which return only links that join components. So no link between buckets' members is lost.
4. Confirmed links become components (see components.py).

Defined results: null or wordless texts have n_shingles 0 and stand alone; documents of fewer than
five words have one shingle; rows with a null doc_id can't be named and are linked with nothing
(component null, kept); rows that repeat a doc_id are each judged by their own text (deduplicate then
keeps one row of a doc_id, the one of the smallest text); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

from .components import components
from .tables import let_go, untouched
from .worker import held

WORDS = 5
PERMUTATIONS = 64
BAND_ROWS = 4
LEADERS = 4  # further leaders of a bucket that the first one leaves in several components
BLOCK, AGAINST = 256, 4096  # nodes of a block in the last step, and of what a block is compared with at once
UNIT_BYTES = 1 << 18  # text hashed at once

_MASK = 0xFFFFFFFFFFFFFFFF
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>"
_tables: dict = {}


def _random(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return np.frombuffer(b"".join(hashlib.blake2b(f"{seed}/{k}".encode(), digest_size=8).digest() for k in range(n)), "<u8")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    held("powers", dict)  # lets go what another operator kept
    if len(_tables.get("up", ())) < n:
        n = max(n, 2 * UNIT_BYTES)
        base = int(_random(1, 1)[0]) | 1
        for name, value in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(n, value, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
        _tables["byte"] = _random(2, 256)
        _tables["a"], _tables["b"] = _random(3, PERMUTATIONS) | np.uint64(1), _random(4, PERMUTATIONS)
    return _tables["up"], _tables["down"]


def _units(texts: list[str | None]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Groups of (text number, words) of about UNIT_BYTES; a longer text is cut into overlapping units."""
    group, size = [], 0
    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        step = UNIT_BYTES // 4
        for a in range(0, max(len(words) - WORDS + 1, 1), step):
            part = words[a:a + step + WORDS - 1]
            n = sum(map(len, part))
            if group and size + n > UNIT_BYTES:
                yield group
                group, size = [], 0
            group.append((k, part))
            size += n
    if group:
        yield group


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, sorted (64-bit polynomial hashes of the words' bytes
    with one blank between words, so equal word sequences and no others agree)."""
    found: list[list] = [[] for _ in texts]
    for group in _units(texts):
        group = [(k, w) for k, w in group if w]
        if not group:
            continue
        raw = np.frombuffer(b" ".join(b" ".join(w) for _, w in group), np.uint8)
        up, down = _powers(len(raw) + 1)
        blanks = np.flatnonzero(raw == 32)
        starts, ends = np.append(0, blanks + 1), np.append(blanks, len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_tables["byte"][raw] * up[:len(raw)], out=sums[1:])
        words = np.array([len(w) for _, w in group])
        n = np.maximum(words - WORDS + 1, 1)
        first = np.repeat(np.cumsum(words) - words, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        last = first + np.repeat(np.minimum(words, WORDS) - 1, n)
        h = (sums[ends[last]] - sums[starts[first]]) * down[starts[first]]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        at = 0
        for (k, _), m in zip(group, n.tolist()):
            found[k].append(h[at:at + m])
            at += m
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.uint64) for f in found]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-max signatures of non-empty sets, one row each: all minima, then all maxima."""
    _powers(1)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    a = 0
    while a < len(sets):  # slices that stay in the cache
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= 1 << 16):
            size += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *(len(s) for s in sets[a:b - 1])])
        y = np.empty_like(flat)
        for k in range(PERMUTATIONS):
            np.multiply(flat, _tables["a"][k], out=y)
            y += _tables["b"][k]
            out[a:b, k] = np.minimum.reduceat(y, starts)
            out[a:b, PERMUTATIONS + k] = np.maximum.reduceat(y, starts)
        a = b
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of every signature; the band's number is part of the key."""
    bands = signature.reshape(len(signature), -1, BAND_ROWS)
    key = np.broadcast_to(_random(5, bands.shape[1]), bands.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = (key ^ bands[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _batches(batch: pa.RecordBatch, size: int = 512) -> Iterator[tuple[pa.Array, list]]:
    for a in range(0, batch.num_rows, size):
        part = batch.slice(a, size)
        yield part.column(0), shingle_sets(part.column(1).to_pylist())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sets in _batches(batch):
            full = [s for s in sets if len(s)]
            keys = band_hashes(signatures(full)) if full else np.zeros((0, 1), np.int64)
            count = [keys.shape[1] if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                                   pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.array(keys.ravel()))})


def _keep_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sets in _batches(batch):
            yield pa.RecordBatch.from_pydict({"node": ids, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def _similar(shared, m, n):
    return 100 * shared >= 75 * (m + n - shared)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their sets -> the pairs that are similar."""
    for batch in batches:
        keep = []
        for s, t in zip(batch.column(2), batch.column(3)):
            s, t = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
            shared = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            keep.append(_similar(shared, len(s), len(t)))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("t"))
    full = pairs.join(left, "x").join(right, "y").select("x", "y", "s", "t")
    return full.mapInArrow(_confirm, "x long, y long")


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's members with its leaders whose set sizes allow a link."""
    lead = leaders.select("key", F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("component").alias("lead_c"))
    met = members.join(lead, "key").where(
        (F.col("component") != F.col("lead_c"))
        & (4 * F.least("n", "lead_n") >= 3 * F.greatest("n", "lead_n")))
    return met.select(F.least("node", "lead").alias("x"), F.greatest("node", "lead").alias("y")).distinct()


def _block_links(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the components of a block and of a bucket: enough to join what is linked."""
    if not left.num_rows:
        return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
    root: dict = {}

    def find(c):
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    read = lambda t: [np.frombuffer(s.as_buffer(), "<u8") for s in t.column("shingles")]
    sets, nodes, comps = read(left), left.column("node").to_pylist(), left.column("component").to_pylist()
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner, size = flat[order], owner[order], np.array([len(s) for s in sets])
    xs, ys = [], []
    for t, node, comp in zip(read(right), right.column("node").to_pylist(), right.column("component").to_pylist()):
        a, b = np.searchsorted(flat, t, "left"), np.searchsorted(flat, t, "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(owner[at], minlength=len(sets))
        for k in np.flatnonzero(_similar(shared, size, len(t))).tolist():
            if (p := find(comps[k])) != (q := find(comp)):
                root[p] = q
                xs.append(nodes[k])
                ys.append(node)
    return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Compare what the leaders left apart: per bucket, everything outside its largest component, in
    blocks, against all of its members; only sets travel, pairs exist inside a task."""
    sized = members.groupBy("key", "component").count().withColumnRenamed("count", "share")
    main = sized.groupBy("key").agg(F.max(F.struct("share", "component"))["component"].alias("main"),
                                    F.sum("share").alias("total"), F.max("share").alias("most"))
    rows = (members.join(main, "key").join(sets, "node")
            .withColumn("blocks", F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int"))
            .withColumn("parts", F.ceil(F.col("total") / AGAINST).cast("int")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    at = ["key", "block", "part"]
    left = rows.where(F.col("component") != F.col("main")).withColumn("block", mine("blocks")).withColumn("part", each("parts"))
    right = rows.withColumn("part", mine("parts")).withColumn("block", each("blocks"))
    pick = [F.col(c).alias(c) for c in (*at, "node", "component", "shingles")]  # fresh names on either side
    return (left.select(*pick).groupBy(*at).cogroup(right.select(*pick).groupBy(*at))
            .applyInArrow(_block_links, "x long, y long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut_lineage(docs.mapInArrow(_sign, _SIGNATURE))
    named = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("node"))

    first = named.join(nodes, "digest").where("doc_id = node")
    banded = first.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(banded.join(shared, "key"))
    let_go(docs.sparkSession)
    popular = members.groupBy("node").agg(F.sum("size").alias("popular"))
    ranked = (members.join(popular, "node")
              .withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("popular"), "node")))
              .where(F.col("rank") <= LEADERS + 1).select("key", "node", "n", "rank"))
    ranked = cut_lineage(ranked)
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(
        _keep_sets, "node long, shingles binary"))
    let_go(docs.sparkSession)

    alone = members.withColumn("component", F.col("node"))
    links = cut_lineage(_linked(_pairs(alone, ranked.where("rank = 1").withColumn("component", F.col("node"))), sets))
    split = cut_lineage(_split(members, links))
    more = _pairs(split, ranked.where("rank > 1").join(split.select("key", "node", "component"), ["key", "node"]))
    links = cut_lineage(links.union(_linked(more, sets)))
    let_go(docs.sparkSession)
    split = _split(members, links).where(F.col("size") > LEADERS + 2)
    found = components(links.union(_blocks(cut_lineage(split), sets)))
    of_set = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("of_set"))
    out = signed.join(of_set, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _split(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that span several components."""
    found = components(links)
    now = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    return now.join(open_keys.select("key"), "key", "left_semi")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, as it is."""
    found = near_duplicates(docs).where("kept")
    keep = found.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()

    def choose(rows: DataFrame) -> DataFrame:
        order = ["text", *[F.col(f"`{c}`") for c in rows.columns if c not in ("doc_id", "text")]]
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
        return rows.where(F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi").withColumn("_row", first).where("_row = 1")

    return untouched(docs, ("_row",), choose).unionByName(docs.where(F.col("doc_id").isNull()))
