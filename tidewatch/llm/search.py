"""Ranked lexical search: many queries at once, by common subexpressions.

1. Postings. One Arrow pass over whole texts counts each document's terms and keeps those that any item asks
   for, as (doc_id, n, term numbers, occurrences) in a compressed table. Partial aggregates over it give the
   documents' number and length and each term's document frequency.
2. Sharing. Term pairs that the most items have in common are joined into a node, again and again (a node can
   be part of a pair), until no two items share a pair. The nodes are a graph in which every node is the sum of
   two others, and an item is a few nodes.
3. Scoring. Per block of documents the terms' scores are laid out once, every node's partial accumulator (one
   sum per document) is computed once from its two parts, and each item's scores are the sum of its nodes. Tasks
   keep an item's `top` best rows only; these are ranked in two levels, so no task meets all of an item's rows.

Items are the stated query set: they are taken in blocks of about BLOCK_TERMS terms, each broadcast, and a further
block reads the texts once more. Integer sums do not depend on the order, so sharing changes no score.

Defined results: null or termless texts are no documents (not counted, never found); a row that repeats is a
document of its own; documents with a null doc_id rank last among equals; rows of one item_id (also a null one)
are one item with the terms of all of them, each once; items without terms and empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .worker import Same, held

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 50
BLOCK_TERMS = 100_000  # terms of the items of a block
PAIR_GROUP = 32  # an item's shared terms are paired within groups of so many
SLICE_BYTES = 4 << 20  # text split at once
CELLS = 4 << 20  # scores laid out at once
SALTS = 32

# byte -> byte: A-Z lower-cased, what ends a term to a blank, everything else kept
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of every item."""
    t = F.translate(F.col("text"), UPPER, LOWER)
    rows = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(TERM), F.lit(0)))).alias("term"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def count_terms(text: str | None, number: dict) -> tuple[int, Counter]:
    """Terms of a text, and how often those that have a number occur."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    n, counts, at = 0, Counter(), 0
    while at < len(raw):
        stop = raw.find(b" ", at + SLICE_BYTES)
        words = raw[at:stop if stop >= 0 else len(raw)].split()
        n += len(words)
        counts.update(map(number.get, words))
        at = stop if stop >= 0 else len(raw)
    counts.pop(None, None)
    return n, counts


def _numbers(terms) -> dict:
    """The numbers of a broadcast list of terms, made once in a worker."""
    return held(Same("terms", terms), lambda: {t.encode(): k for k, t in enumerate(terms)})


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The documents that have terms: their length and the occurrences of the terms asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(shared.value)
        for batch in batches:
            ids, ns, ends, found, times = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = count_terms(text.as_py(), number)
                if n:
                    ids.append(doc_id)
                    ns.append(n)
                    found += counts.keys()
                    times += counts.values()
                    ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                "counts": pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _POSTINGS)


def share(sets: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, plans): node n_terms + k is the sum of the two of nodes[k]; plans[i] are the summands of set i."""
    often = Counter(t for s in sets for t in s)
    plans, groups, owner = [[] for _ in sets], [], []
    for i, s in enumerate(sets):
        common = sorted((t for t in s if often[t] > 1), key=lambda t: (-often[t], t))
        plans[i] = [t for t in s if often[t] == 1]
        for a in range(0, len(common), PAIR_GROUP):
            groups.append(set(common[a:a + PAIR_GROUP]))
            owner.append(i)
    where = defaultdict(set)
    for g, members in enumerate(groups):
        order = sorted(members)
        for k, a in enumerate(order):
            for b in order[k + 1:]:
                where[a, b].add(g)
    heap = [(-len(w), pair) for pair, w in where.items() if len(w) > 1]
    heapq.heapify(heap)
    nodes = []
    while heap:
        n, pair = heapq.heappop(heap)
        held = where.get(pair, ())
        if len(held) != -n:  # it has been broken up since
            if len(held) > 1:
                heapq.heappush(heap, (-len(held), pair))
            continue
        a, b = pair
        node = n_terms + len(nodes)
        nodes.append(pair)
        met = set()
        for g in list(held):
            groups[g] -= {a, b}
            for x in groups[g]:
                where[min(a, x), max(a, x)].discard(g)
                where[min(b, x), max(b, x)].discard(g)
                where[x, node].add(g)  # a new node has the largest number
                met.add(x)
            groups[g].add(node)
        del where[pair]
        for x in met:
            if len(where[x, node]) > 1:
                heapq.heappush(heap, (-len(where[x, node]), (x, node)))
    for g, members in enumerate(groups):
        plans[owner[g]] += sorted(members)
    return nodes, plans


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The best rows of one item so far: score falling, then doc_id rising, nulls last."""

    def __init__(self, top: int):
        self.top, self.floor = top, 1
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, null: np.ndarray, docs: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if not len(at):
            return
        if len(at) > self.top:  # no row below the top-th score can be among the best
            least = np.partition(scores[at], len(at) - self.top)[len(at) - self.top]
            at = at[scores[at] >= least]
        score = np.concatenate([self.score, scores[at]])
        null, doc = np.concatenate([self.null, null[at]]), np.concatenate([self.doc, docs[at]])
        order = np.lexsort((doc, null, -score))[:self.top]
        self.score, self.null, self.doc = score[order], null[order], doc[order]
        if len(order) == self.top:
            self.floor = max(1, int(self.score[-1]))


def _scorer(plan_b, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_b.value
        weights, nodes, plans, n_docs, length = (plan[k] for k in ("weights", "nodes", "plans", "n_docs", "length"))
        n_terms = len(weights)
        best = [_Best(top) for _ in plans]
        width = max(1, CELLS // (n_terms + len(nodes) + 1))
        for whole in batches:
            for a in range(0, whole.num_rows, width):
                batch = whole.slice(a, width)
                n = batch.column(1).to_numpy()
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                docs = batch.column(0).fill_null(0).to_numpy()
                terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(n)), np.diff(batch.column(2).offsets.to_numpy()))
                m = 100 - 50 + (50 * n * n_docs) // length
                sums = np.zeros((n_terms + len(nodes), len(n)), np.int64)
                sums[terms, owner] = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[owner]))
                for k, (x, y) in enumerate(nodes):  # parts always stand before
                    np.add(sums[x], sums[y], out=sums[n_terms + k])
                for keep, parts in zip(best, plans):
                    if parts:
                        total = sums[parts[0]].copy()
                        for x in parts[1:]:
                            total += sums[x]
                        keep.add(total, null, docs)
        for k, keep in enumerate(best):
            if len(keep.score):
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(np.full(len(keep.score), k, np.int32)),
                    "doc_id": pa.array(keep.doc, mask=keep.null), "score": pa.array(keep.score)})

    return score


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of every item with a score above 0."""
    spark = docs.sparkSession
    asked = item_terms(items)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    kind = items.schema["item_id"].dataType
    out, sizes = None, None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # a bounded share of the query set
        terms = sorted({t for r in rows for t in r["terms"]})
        found = stored(postings(docs, terms), "postings")
        if sizes is None:
            sizes = found.agg(F.count("*"), F.sum("n")).first()
        n_docs, length = sizes
        df = {r[0]: r[1] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # one row a term
        weights = np.array([weight(n_docs, df[k]) if k in df else 0 for k in range(len(terms))], np.int64)
        number = {t: k for k, t in enumerate(terms)}
        sets = [[k for k in map(number.get, r["terms"]) if weights[k] > 0] for r in rows]
        nodes, plans = share(sets, len(terms))
        plan = spark.sparkContext.broadcast(
            {"weights": weights, "nodes": nodes, "plans": plans, "n_docs": n_docs or 0, "length": length or 1})
        best = found.mapInArrow(_scorer(plan, top), "item int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best = best.withColumn("salt", F.spark_partition_id() % SALTS)
        for keys in (["item", "salt"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], _names(kind))
        best = best.join(ids, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], _names(kind)).selectExpr("item_id", "item AS rank", "0L AS doc_id", "0L AS score")
    return out


def _names(kind):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([StructField("item", IntegerType()), StructField("item_id", kind)])
