"""Conversation structure repair by iterative-deepening A*.

A conversation is repaired if its role initials read `(s?(ua)+)?`. Edits and their initials: D deletes a row (2; a
blank or repeated row must go), I inserts an empty user or assistant turn (5), K keeps a row (0), R gives it the
role user or assistant (1); a truncated row that stays adds 5. Which role an insertion or a new role is follows
from what stands before it, so the initials alone say what is done.

The search deepens a cost bound. Under a bound it goes depth first, trying edits in ASCII order (D, I, K, R), so the
first path that it accepts is the least text among the cheapest. A state is (row, role that comes next); a table
holds the largest remaining bound under which each state has failed. It prunes later visits, under later bounds as
well, and it tightens the estimate, which starts as the sum of each remaining row's cheapest edit.

Scale. Rows are sorted over range partitions by (conversation, turn), as narrow rows without texts. A search never
sees more than CHUNK rows: a longer conversation, or one that goes over a partition's end, is searched chunk by chunk,
between each state at the chunk's start and each at its end, and the results are put together (cheapest, then least
text). So a conversation of any size is searched by many tasks; what meets in one place is one record for each
partition that holds a part of it. Texts move once, sorted by conversation, to be digested: a digest over a
conversation's repaired text is sequential by its nature, and its rows pass through one task as a stream, of which only a
batch is held.

Defined results: a null role or text is one blank; rows are ordered by turn (nulls first), rows of one turn by role
and by their text's digest; equal rows repeat each other. Conversations without rows have zeros, an empty
audit and the digest of nothing; rows with a null conv_id are one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free, stored

CHUNK = 96  # rows that a search sees at once
DELETE, INSERT, RENAME, TRUNCATED = 2, 5, 1, 5  # costs
ROLES = {"u": "user", "a": "assistant"}
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # last initial, next one
STATES = ("", "s", "u", "a")  # the last initial so far
GOALS = ("", "a")  # a conversation may end here
_WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}  # what an insertion or a new role is
_PART = ("conv_id long, part int, first string, last string, illegal long, whole boolean, "
         "paths array<struct<enter: string, leave: string, cost: long, audit: string>>")
_PATHS = pa.list_(pa.struct([("enter", pa.string()), ("leave", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


class Search:
    """Cheapest edits of some rows, from a state at their start to one of `goals` at their end.

    A row is (role initial, must go, is truncated). What failed is remembered for all starts.
    """

    def __init__(self, rows: list[tuple[str, bool, bool]], goals: tuple[str, ...]):
        self.rows, self.goals, self.failed = rows, goals, {}
        self.rest = [0] * (len(rows) + 1)  # the least that the rows from here on cost
        for k in range(len(rows) - 1, -1, -1):
            role, gone, truncated = rows[k]
            self.rest[k] = self.rest[k + 1] + (DELETE if gone or truncated else 0 if role and role in "sua" else RENAME)

    def need(self, k: int, state: str) -> int:
        return max(self.rest[k], self.failed.get((k, state), -1) + 1)

    def _down(self, k: int, state: str, left: int) -> str | None:
        """Edits from here on within `left`, or none."""
        if k == len(self.rows) and state in self.goals:
            return ""
        if self.need(k, state) > left:
            return None
        if k < len(self.rows):
            role, gone, truncated = self.rows[k]
            if left >= DELETE and (path := self._down(k + 1, state, left - DELETE)) is not None:
                return "D" + path
        if left >= INSERT and (path := self._down(k, _WANTED[state], left - INSERT)) is not None:
            return "I" + path
        if k < len(self.rows) and not gone:
            stay = left - (TRUNCATED if truncated else 0)
            if stay >= 0 and (to := NEXT.get((state, role))) and (path := self._down(k + 1, to, stay)) is not None:
                return "K" + path
            if stay >= RENAME and (path := self._down(k + 1, _WANTED[state], stay - RENAME)) is not None:
                return "R" + path
        self.failed[k, state] = max(left, self.failed.get((k, state), -1))
        return None

    def run(self, start: str) -> tuple[int, str]:
        """(cost, edits) of the cheapest path, the least of those; the bound grows by what is surely needed."""
        bound = self.need(0, start)
        while (path := self._down(0, start, bound)) is None:
            bound = max(bound + 1, self.need(0, start))
        return bound, path


def reachable(start: str, goal: str) -> bool:
    """Whether edits can lead from a state to another (insertions always lead to u and a)."""
    return goal in "ua" and goal != "" or start == goal or (start == "" and goal == "s")


def paths_of(rows: list[tuple[str, bool, bool]], starts: tuple[str, ...]) -> dict:
    """{(start, end): (cost, edits)} of a chunk; an end that needs a system row has none without it."""
    out = {}
    for goal in STATES:
        search = Search(rows, (goal,))
        for start in starts:
            if goal == "s" and start == "" and not any(r[0] == "s" and not r[1] for r in rows):
                continue
            if reachable(start, goal):
                out[start, goal] = search.run(start)
    return out


def follow(a: dict, b: dict) -> dict:
    """Paths through two neighbouring parts."""
    out = {}
    for (start, middle), (cost, edits) in a.items():
        for (enter, end), (more, rest) in b.items():
            if enter == middle:
                way = (cost + more, edits + rest)
                if (start, end) not in out or way < out[start, end]:
                    out[start, end] = way
    return out


def _ending(paths: dict) -> tuple[int, str]:
    return min(way for (start, end), way in paths.items() if start == "" and end in GOALS)


def _is_illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


class _Part:
    """The rows of one conversation within one partition."""

    def __init__(self, conv, opened: bool):
        self.conv, self.opened = conv, opened  # opened: no part of it lies in an earlier partition
        self.rows, self.paths, self.first, self.last, self.illegal, self.chunks = [], None, None, None, 0, 0

    def add(self, role: str, gone: bool, truncated: bool) -> None:
        if self.first is None:
            self.first = role
        else:
            self.illegal += _is_illegal(self.last, role)
        self.last = role
        if len(self.rows) == CHUNK:
            self._take()
        self.rows.append((role, gone, truncated))

    def _take(self) -> None:
        if self.paths is None:
            self.paths = paths_of(self.rows, ("",) if self.opened else STATES)
        else:
            self.paths = follow(self.paths, paths_of(self.rows, tuple({end for _, end in self.paths})))
        self.rows = []

    def done(self, closed: bool) -> dict:
        """closed: no part of it lies in a later partition."""
        whole = self.opened and closed
        if whole and self.paths is None:
            cost, edits = Search(self.rows, GOALS).run("")
            paths = [("", "", cost, edits)]
        else:
            self._take()
            paths = [("", "", *_ending(self.paths))] if whole else [(*k, *v) for k, v in self.paths.items()]
        return {"conv_id": self.conv, "first": self.first, "last": self.last, "illegal": self.illegal, "whole": whole,
                "paths": [dict(zip(("enter", "leave", "cost", "audit"), p)) for p in paths]}


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition -> one record for each conversation in it."""
    from pyspark import TaskContext

    number, part, out = TaskContext.get().partitionId(), None, []

    def flush():
        rows = {c: [r[c] for r in out] for c in ("conv_id", "first", "last", "illegal", "whole", "paths")}
        out.clear()
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array(rows["conv_id"], pa.int64()), "part": pa.array([number] * len(rows["conv_id"]), pa.int32()),
            "first": pa.array(rows["first"], pa.string()), "last": pa.array(rows["last"], pa.string()),
            "illegal": pa.array(rows["illegal"], pa.int64()), "whole": pa.array(rows["whole"], pa.bool_()),
            "paths": pa.array(rows["paths"], _PATHS)})

    for batch in batches:
        for conv, role, gone, truncated, copies in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if part is None or conv != part.conv:
                if part is not None:
                    out.append(part.done(True))
                part = _Part(conv, part is not None)  # the partition's first conversation may have begun before
                if len(out) >= 2000:
                    yield flush()
            part.add(role, gone, truncated)
            for _ in range(copies - 1):
                part.add(role, True, False)
    if part is not None:
        out.append(part.done(False))
    if out:
        yield flush()


def _join_parts(table: pa.Table) -> pa.Table:
    """The parts of one conversation (one for each partition that holds some of it) -> one record."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    paths, illegal, last = {("", ""): (0, "")}, 0, None
    for r in rows:
        paths = follow(paths, {(p["enter"], p["leave"]): (p["cost"], p["audit"]) for p in r["paths"]})
        illegal += r["illegal"] + (last is not None and _is_illegal(last, r["first"]))
        last = r["last"]
    cost, edits = _ending(paths)
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "illegal": pa.array([illegal], pa.int64()),
                     "cost": pa.array([cost], pa.int64()), "audit": [edits]})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its audit first -> the digest of each repaired conversation."""
    convs, digests, conv, edits, at, state, sha, started = [], [], None, "", 0, "", None, False

    def write(role, text):
        nonlocal started
        sha.update((("\n" if started else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        started = True

    def inserted():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = _WANTED[state]
            write(ROLES[state], "")
            at += 1

    def end():
        inserted()
        if at != len(edits):
            raise ValueError("rows and edits do not fit")
        convs.append(conv)
        digests.append(sha.hexdigest())

    for batch in batches:
        for c, audit, role, text, copies in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if audit is not None:
                if sha is not None:
                    end()
                conv, edits, at, state, sha, started = c, audit, 0, "", hashlib.sha256(), False
                continue
            for _ in range(copies):
                inserted()
                edit = edits[at]
                at += 1
                if edit == "K":
                    state = role[:1]
                    write(role, text)
                elif edit == "R":
                    state = _WANTED[state]
                    write(ROLES[state], text)
        if len(convs) > 5000:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(convs, pa.int64()), "repaired_sha256": pa.array(digests, pa.string())})
            convs, digests = [], []
    if sha is not None:
        end()
    if convs:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(convs, pa.int64()), "repaired_sha256": pa.array(digests, pa.string())})


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with planted faults, by a checksum of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       blank("role").alias("role"), blank("text").alias("text"), case.alias("case")).where("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).alias("copies"))


def as_rows(rows: DataFrame) -> DataFrame:
    """Plain rows as (conv_id, turn, role, text, copies)."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def repair(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    `rows` are (conv_id, turn, role, text, copies); `convs` may name conversations that have no rows left.
    """
    ink = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    marked = rows.withColumns({
        "digest": F.unhex(F.sha2("text", 256)), "blank": F.length(ink) == 0,
        "truncated": ~F.substring(ink, -1, 1).isin(".", "!", "?")})
    key = ["conv_id", "turn", "role", "digest"]
    narrow = marked.groupBy(*key).agg(F.sum("copies").cast("int").alias("copies"), F.first("blank").alias("blank"),
                                      F.first("truncated").alias("truncated"))
    narrow = stored(narrow, "turns")  # equal rows of a turn are one row from here on
    seen = narrow.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("earliest"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("conv_id", "role", "digest")]
    turns = narrow.alias("n").join(seen.alias("e"), same).select(
        "n.*", (~F.col("n.turn").eqNullSafe(F.col("e.earliest.turn"))).alias("again"))
    turns = stored(turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "digest", "copies",
                                "blank", "again", "truncated"), "turns")
    free(narrow)

    extra = F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("again").cast("int"))
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).cast("long").alias("blank"),
        F.sum(extra).cast("long").alias("duplicate"),
        F.sum((~F.col("blank") & ~F.col("again") & F.col("truncated")).cast("int")).cast("long").alias("truncated"))

    order = [F.asc_nulls_first(c) for c in key]
    parts = (turns.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("conv_id", "initial", (F.col("blank") | F.col("again")).alias("gone"), "truncated", "copies")
             .mapInArrow(_search, _PART))
    parts = stored(parts, "paths")
    whole = parts.where("whole").select("conv_id", "illegal", F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"))
    found = stored(whole.unionByName(parts.where("NOT whole").groupBy("conv_id").applyInArrow(
        _join_parts, "conv_id long, illegal long, cost long, audit string")), "audits")
    free(parts)

    texts = marked.select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "copies", "turn", "digest")
    heads = found.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("role", "string"), ("text", "string"), ("copies", "int"), ("turn", "long"), ("digest", "binary"))])
    digests = (texts.unionByName(heads).repartition("conv_id")
               .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest")
               .select("conv_id", "audit", "role", "text", "copies")
               .mapInArrow(_digest, "conv_id long, repaired_sha256 string"))

    out = (found.alias("f").join(counts.alias("c"), F.col("f.conv_id").eqNullSafe(F.col("c.conv_id")))
           .join(digests.alias("d"), F.col("f.conv_id").eqNullSafe(F.col("d.conv_id")))
           .select("f.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    if convs is None:
        return out
    names = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (names.alias("n").join(out.alias("o"), F.col("n.conv_id").eqNullSafe(F.col("o.conv_id")), "left")
            .select("n.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
            .withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")),
                          "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}))
