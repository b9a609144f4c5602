"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

Every Python worker holds an in-process DuckDB with two tables made from a rank file: the vocabulary
(id, bytes) and the merge table (left id, right id -> id of the joined bytes). Per batch of texts:

1. The pattern cuts whole texts into words; only the batch's distinct words that the worker has
   not met go on. A word that is itself in the vocabulary is that token.
2. A recursive query holds one row per (word, position, token). A round joins neighbours with the merge
   table and contracts each word's leftmost pair of minimum rank; a word without such a pair stops. In
   words over LONG_WORD bytes a round contracts all (non-overlapping) occurrences of that pair, if no
   pair that holds the new token has a lower rank, as then the leftmost rule would take them in turn anyway.
   A query runs a bounded number of rounds and goes on from the rows it reached, so the rows that it
   holds are bounded too.
3. Decoding joins the rows (text, position, id) with the vocabulary and puts every text's bytes together by an
   ordered aggregation.

Texts are cut into pieces where a single blank stands between two characters that are no white space (no
match crosses such a place), so the pattern has to run on a batch's distinct pieces only. Nothing is shuffled; a worker holds the vocabulary, at most KNOWN
words and one group of texts.

Defined results: a null text is an empty one (no ids); repeated rows are encoded alike; other columns
pass through, and a column with the name of a result is replaced; an empty table gives an empty result.
A word of n letters without any blank, digit or mark takes up to n rounds over n rows: words
of thousands of different letters are slow, not wrong.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import split_safe, tokenizer_path
from .worker import held

RANKS = "byte_bpe_50k.tiktoken"
SLICE_CHARS, GROUP_IDS = 2 << 20, 1 << 19  # text and ids handled at once
KNOWN = 800_000  # words that a worker remembers; beyond it the memory starts anew
START_ROWS = 1 << 18  # bytes (first rows) of the words in one recursive query
LONG_WORD = 64
LEAST_ROUNDS, ROUND_ROWS = 4, 1 << 22  # rounds of a query: so many, or more while their rows stay below this

_STEP = """
WITH RECURSIVE step(w, p, id, n) AS (
  SELECT w, p, id, 0 FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT w, p, id, n, s.before, k.alone, (k.m::BIGINT << 32) + p AS place
     FROM (SELECT *, lead(id) OVER row AS next_id, lag(p) OVER row AS before FROM step WINDOW row AS (PARTITION BY w ORDER BY p)) s
     LEFT JOIN merges k ON k.pair = (s.id::BIGINT << 32) + s.next_id),
   least AS (SELECT w, min(place) AS best FROM pairs WHERE place IS NOT NULL AND n < {rounds} GROUP BY w)
   {contract})
), last AS (SELECT w, max(n) AS n FROM step GROUP BY w)
SELECT w, p, id, n = {rounds} AS unfinished FROM step JOIN last USING (w, n)"""
# a place is a rank and a position; the row behind the contracted one goes
_LEFTMOST = """SELECT w, p, (CASE WHEN place = best THEN best >> 32 ELSE id END)::INTEGER, n + 1
   FROM pairs JOIN least USING (w) WHERE before IS NULL OR before <> best & 4294967295"""
# the first, third, ... of every run of neighbouring occurrences, as in (aa)(aa)a
_EVERY = """SELECT w, p, (CASE WHEN picked THEN best >> 32 ELSE id END)::INTEGER, n + 1
   FROM (SELECT *, lag(picked) OVER row AS gone
         FROM (SELECT *, found AND (place = best OR NOT alone AND
                 (r - max(CASE WHEN found THEN 0 ELSE r END) OVER (PARTITION BY w ORDER BY p)) % 2 = 1) AS picked
               FROM (SELECT *, coalesce(place >> 32 = best >> 32, false) AS found, row_number() OVER row AS r
                     FROM pairs JOIN least USING (w) WINDOW row AS (PARTITION BY w ORDER BY p)))
         WINDOW row AS (PARTITION BY w ORDER BY p))
   WHERE NOT coalesce(gone, false)"""


def ranks_path(name: str = RANKS) -> str:
    """Place of a public rank file (the path is a parameter of every function)."""
    return tokenizer_path(name)


def split_pattern() -> str:
    """The public pattern that cuts texts into words before the merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """The tables of a rank file in a DuckDB of this process, and what the worker has met."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.cut, self.safe = regex.compile(pattern), regex.compile(r"(?<=\S)(?= \S)")
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.known = 0
        # bytes as characters 0-255, so that SQL can cut and join them
        self._table("given", piece=[k.decode("latin-1") for k in ranks], id=pa.array(ranks.values(), pa.int32()))
        self._run("CREATE TABLE vocab AS SELECT id, piece FROM given ORDER BY id")
        self._run("""CREATE TABLE merges AS
            WITH pairs AS (SELECT a.id AS l, b.id AS r, v.id AS m
              FROM vocab v, unnest(range(1, length(v.piece))) AS u(k)
              JOIN vocab a ON a.piece = left(v.piece, k) JOIN vocab b ON b.piece = substr(v.piece, k + 1)),
            lower AS (SELECT l AS id FROM pairs WHERE m < l UNION SELECT r FROM pairs WHERE m < r)
            SELECT (l::BIGINT << 32) + r AS pair, m, m IN (SELECT id FROM lower) AS alone FROM pairs""")
        whole = []
        for k, i in ranks.items():
            try:
                whole.append((k.decode(), i))
            except UnicodeDecodeError:
                pass
        self._table("given", word=[k for k, _ in whole], id=pa.array([i for _, i in whole], pa.int32()))
        self._run("CREATE TABLE whole AS SELECT word, id FROM given")
        self._run("CREATE TABLE known (word VARCHAR, ids INTEGER[])")
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _table(self, name: str, **columns) -> None:
        """The columns as a table for the next queries (only referred to, until another takes the name)."""
        self.db.register(name, pa.table(columns))

    def _run(self, sql: str) -> None:
        self.db.execute(sql).fetchall()

    def _arrow(self, sql: str) -> pa.Table:
        return self.db.sql(sql).to_arrow_table()

    def slices(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Groups of (text number, part of it) of about SLICE_CHARS; long texts are cut at safe places."""
        group, size = [], 0
        for k, text in enumerate(texts):
            at = 0
            while True:
                stop = len(text)
                if stop - at > SLICE_CHARS:
                    found = self.safe.search(text, at + SLICE_CHARS)
                    stop = found.start() if found else stop
                group.append((k, text[at:stop]))
                size += stop - at
                if size >= SLICE_CHARS:
                    yield group
                    group, size = [], 0
                at = stop
                if at >= len(text):
                    break
        if group:
            yield group

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        out = [[] for _ in texts]
        for group in self.slices(texts):
            pieces, ends = [], []
            for _, part in group:
                first, *rest = split_safe(part)
                pieces.append(" " + first)  # the others start with no blank, and one stands before them
                pieces += rest
                ends.append(len(pieces))
            coded = pa.array(pieces, pa.string()).dictionary_encode()
            found = self._pieces(coded.dictionary.to_pylist()).take(coded.indices)
            offsets = found.offsets.to_numpy()
            raw = found.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = offsets[0]
            for (k, _), stop in zip(group, offsets[ends].tolist()):
                out[k].append(raw[at:stop].tobytes())
                at = stop
        return [b"".join(parts) for parts in out]

    def _pieces(self, pieces: list[str]) -> pa.ListArray:
        """Ids of distinct pieces: the ids of their words one after another."""
        words, ends = [], [0]
        for p in pieces:
            words += self.cut.findall(p[1:] if p[:1] == " " else " " + p)
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        found = self._ids(coded.dictionary).take(coded.indices)
        return pa.ListArray.from_arrays(found.offsets.take(pa.array(ends)), found.values)

    def _ids(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of distinct words, in their order."""
        self._table("given", word=words, place=np.arange(len(words), dtype=np.int32))
        new = self._arrow("""SELECT word, strlen(word) AS size FROM given ANTI JOIN known USING (word)
                             ANTI JOIN whole USING (word) ORDER BY size""")
        if self.known + new.num_rows > KNOWN:
            self._run("DROP TABLE known")
            self._run("CREATE TABLE known (word VARCHAR, ids INTEGER[])")
            self.known = 0
            new = self._arrow("""SELECT word, strlen(word) AS size FROM given ANTI JOIN whole USING (word) ORDER BY size""")
        ends = np.cumsum(new["size"].to_numpy())
        a = 0
        while a < new.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + START_ROWS, "right")))
            self._merge(new["word"].slice(a, b - a).combine_chunks())
            a = b
        self.known += new.num_rows
        found = self._arrow("""SELECT coalesce(k.ids, [w.id]) AS ids FROM given LEFT JOIN whole w USING (word)
                               LEFT JOIN known k USING (word) ORDER BY place""")["ids"]
        return found.combine_chunks() if found.num_chunks != 1 else found.chunk(0)

    def _merge(self, words: pa.StringArray) -> None:
        """Encode words by recursive queries and keep them."""
        raw = [w.encode() for w in words.to_pylist()]
        sizes = np.array([len(w) for w in raw])
        first = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        if (first < 0).any():
            raise ValueError("the rank file lacks single bytes")
        state = {"w": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "id": first,
                 "p": (np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)}
        self._table("chunk", w=np.arange(len(raw), dtype=np.int32), word=words)
        contract = _EVERY if sizes.max() > LONG_WORD else _LEFTMOST
        self._run("CREATE TEMP TABLE reached (w INTEGER, p INTEGER, id INTEGER)")
        while len(state["w"]):
            self._table("start", **state)
            rounds = max(LEAST_ROUNDS, ROUND_ROWS // len(state["w"]))
            got = self._arrow(_STEP.format(rounds=rounds, contract=contract))
            self._table("got", **{c: got[c] for c in got.column_names})
            self._run("INSERT INTO reached SELECT w, p, id FROM got WHERE NOT unfinished")
            rest = self._arrow("SELECT w, p, id FROM got WHERE unfinished")
            state = {c: rest[c].to_numpy() for c in rest.column_names}
        self._run("""INSERT INTO known SELECT word, ids FROM chunk
                     JOIN (SELECT w, list(id ORDER BY p) AS ids FROM reached GROUP BY w) USING (w)""")
        self._run("DROP TABLE reached")

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that sequences of ids stand for."""
        out, group, size = [[] for _ in encoded], [], 0
        for k, raw in enumerate(encoded):
            for a in range(0, len(raw), 4 * GROUP_IDS):
                group.append((k, raw[a:a + 4 * GROUP_IDS]))
                size += len(group[-1][1])
                if size >= 4 * GROUP_IDS:
                    self._decode(group, out)
                    group, size = [], 0
        if group:
            self._decode(group, out)
        return [b"".join(parts) for parts in out]

    def _decode(self, group: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        ids = np.frombuffer(b"".join(raw for _, raw in group), "<u4").astype(np.int64)
        sizes = [len(raw) // 4 for _, raw in group]
        self._table("coded", s=np.repeat(np.arange(len(group), dtype=np.int32), sizes), id=ids,
                    p=np.arange(len(ids), dtype=np.int32))
        found = self._arrow("""SELECT string_agg(piece, '' ORDER BY p) AS piece, count(*) AS n
                               FROM coded JOIN vocab USING (id) GROUP BY s ORDER BY s""")
        if found["n"].to_pylist() != sizes:
            raise ValueError("ids that the vocabulary lacks")
        for (k, _), text in zip(group, found["piece"].to_pylist()):
            out[k].append(text.encode("latin-1"))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    return held(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def encoded(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Ids of a text column (null: none) as little-endian unsigned 32-bit integers (binary)."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(codec(path, pattern).encode([t or "" for t in texts.to_pylist()]), pa.binary())

    return F.arrow_udf(encode, "binary")(text)


def decoded(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Bytes that a column of encoded ids stands for (null: none)."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(codec(path, pattern).decode([b or b"" for b in batch.to_pylist()]), pa.binary())

    return F.arrow_udf(decode, "binary")(ids)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add `ids`, the ids of every text, and `decoded`, the bytes that these ids stand for, in one pass."""
    path, pattern = path or ranks_path(), pattern or split_pattern()
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = codec(path, pattern)
            ids = own.encode([t or "" for t in texts.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())], fields=list(kind))

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")],
                       F.arrow_udf(both, "ids binary, decoded binary")(F.col("text")).alias("_coded"))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_coded"], "_coded.ids", "_coded.decoded")
