"""Conversation repair, ranked search and byte-level BPE against brute force and the public library."""

import base64
import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF_MID, SF_SMALL
from tidewatch.llm import byte_bpe, components, conversations, queries, search
from tidewatch.session import cut_lineage

DOCS = "doc_id long, text string, lang string, ids string, n long"
CONV = "conv_id long, turn long, role string, text string, audit string"
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _table(spark, name, sf=SF_SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- 11 conversations


def _repair(df):
    rows = conversations.repair(conversations.damage(df), df).collect()
    out = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in rows}
    assert len(out) == len(rows)
    return out


def _plain(rows):
    return brute.repaired(brute.damaged(rows), {r[0] for r in rows})


def test_search_equals_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(400):
        rows = [(rnd.choice("suauaua x"), rnd.random() < 0.2, False) for _ in range(rnd.randrange(9))]
        rows = [(r.strip(), g, not g and rnd.random() < 0.3) for r, g, _ in rows]
        cost, audit = conversations.Search(rows, conversations.GOALS).run("")
        assert (cost, audit) == brute.cheapest(rows)
        cut, paths = rnd.randrange(len(rows) + 1), {("", ""): (0, "")}
        for part in (rows[:cut], rows[cut:]):
            paths = conversations.follow(paths, conversations.paths_of(part, conversations.STATES))
        assert conversations._ending(paths) == (cost, audit)


def test_repair_of_whole_tables(spark):
    for sf in (SF_SMALL, SF_MID):
        df = _table(spark, "conversations", sf)
        got = queries.QUERIES["op11_repair_conversations"](spark, sf).collect()
        want = _plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
        assert {r["conv_id"]: tuple(r[c] for c in RESULT) for r in got} == want and len(got) == len(want)


def test_repair_of_long_odd_and_missing_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 7)
    rnd = random.Random(2)
    say = lambda: rnd.choice(["Yes.", "No!", "well", "", " \t", "Why?", "é。", "a.\n\x85", "Go. \n"])
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    rows = [(1, k, role(), say() + ("" if k % 3 else f" {k}.")) for k in range(2500)]  # most of all rows
    rows += [(c, rnd.choice([None, 0, 1, 2, 5]), role(), rnd.choice([say(), None])) for c in (2, 3, None) for _ in range(12)]
    rows += [(4, 2**40, "user", "x" * 300_000 + "."), (4, -5, "system", "a"), (5, None, None, None)] + [rows[9]] * 40
    gone = next(c for c in range(10, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "dropped."))
    df = spark.createDataFrame([(*r, "clash") for r in rows], CONV).repartition(5)
    got = _repair(df)
    assert got == _plain(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert _repair(spark.createDataFrame([], CONV)) == {}


def test_damage_is_not_part_of_the_operator(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q."), (1, 2, "assistant", "a."), (2, 0, "assistant", "a."), (2, 1, "assistant", "b.")]
    got = {r["conv_id"]: r for r in conversations.repair(conversations.as_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KKK") and (got[2]["cost"], got[2]["audit"]) == (1, "RK")


# ---------------------------------------------------------------- 12 search


def _ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark):
    docs, items = _table(spark, "documents"), _table(spark, "benchmark")
    want = sorted(brute.ranked([tuple(r) for r in docs.select("doc_id", "text").collect()],
                               [tuple(r) for r in items.select("item_id", "text").collect()]), key=repr)
    assert _ranked(search.search(docs, items)) == want
    assert _ranked(search.search(docs.repartition(3), items, block_terms=300)) == want  # several blocks of items


def test_search_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE_BYTES", 64)
    long = " ".join(f"w{k % 77}" for k in range(20_000))
    texts = [None, "", " .;", "One one TWO", "one two three", "é two É", long, long, "x" * 100_000 + " two", "one"]
    docs = [(k, t, "en", "clash", 1) for k, t in enumerate(texts)] + [(3, "One one TWO", None, None, None), (None, "one two", None, None, 1)]
    items = [(1, "one two"), (1, "Two é"), (2, None), (3, "nothing here"), (None, "w5 w6 w7 x"), (4, "w1 W2 w3 one"), (5, "w1 w2 w3 two")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, rank int")
    want = sorted(brute.ranked([r[:2] for r in docs], items, 3), key=repr)
    assert _ranked(search.search(d, i, top=3)) == want and any(r[2] is None for r in brute.ranked([r[:2] for r in docs], items))
    assert _ranked(search.search(d, i)) == sorted(brute.ranked([r[:2] for r in docs], items), key=repr)
    for a, b in ((d.limit(0), i), (d, i.limit(0))):
        empty = search.search(a, b)
        assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_nodes_keep_every_sum():
    rnd = random.Random(3)
    base = [rnd.sample(range(60), 12) for _ in range(4)]
    sets = [sorted(set(rnd.choice(base) + rnd.sample(range(60), 6))) for _ in range(30)]
    nodes, plans = search.share(sets, 60)
    value = [rnd.randrange(10**6) for _ in range(60)]
    for a, b in nodes:
        value.append(value[a] + value[b])
    assert [sum(value[x] for x in p) for p in plans] == [sum(value[t] for t in s) for s in sets]
    assert len(nodes) + sum(map(len, plans)) < sum(map(len, sets))  # sharing saves additions


# ---------------------------------------------------------------- 13 byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(byte_bpe.ranks_path(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


def _same(own, library, texts):
    coded = own.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(coded) == [t.encode() for t in texts]


def test_codec_equals_the_library(library, monkeypatch):
    own = byte_bpe.codec(byte_bpe.ranks_path(), byte_bpe.split_pattern())
    rnd = random.Random(1)
    odd = ["", " ", "  x  y\n\n z \x1c\x85 é中文😀 <|endoftext|>", "don't I'LL we're 12345 a1b2", "a\n", "\r\n\t"]
    odd += [c * 3000 for c in ("a", "=", " ", "é", "中", "ab", "0", "aaab", "\n", "　")]  # long runs
    odd += ["".join(rnd.choice("ab =-é\n0'中 ") for _ in range(200)) for _ in range(200)]
    odd += ["".join(rnd.choice("abcdefghij") for _ in range(700))]
    _same(own, library, odd)
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 50)  # long texts cut into slices, groups of ids, many small queries
    monkeypatch.setattr(byte_bpe, "GROUP_IDS", 7)
    monkeypatch.setattr(byte_bpe, "KNOWN", 20)
    monkeypatch.setattr(byte_bpe, "START_ROWS", 30)
    monkeypatch.setattr(byte_bpe, "ROUND_ROWS", 0)
    _same(own, library, odd[:6] + ["some words, and again some words " * 30] + odd[-30:])


def test_bpe_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in _table(spark, "documents").collect()}
    got = queries.QUERIES["op13_recursive_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_bpe_odd_rows(spark, library):
    rows = [(0, None, "en", "clash", 1), (1, "", None, None, None), (None, "hello  world", None, "x", 2), (1, "", None, None, None),
            (2, "word " * 60_000, "en", "clash", 3)]
    df = spark.createDataFrame(rows, DOCS)
    got = byte_bpe.round_trip(df).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "n", "ids", "decoded"}
    for r in got:
        text = r["text"] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert byte_bpe.round_trip(df.limit(0)).collect() == []
    back = df.select(byte_bpe.decoded(byte_bpe.encoded(df["text"])).alias("back"), "text").collect()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in back)


# ---------------------------------------------------------------- lineage and components


def test_components_leave_no_shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    shuffles = lambda: set(Path(folder).rglob("shuffle_*.data"))
    before = shuffles()
    links = spark.createDataFrame([(k, k + 1) for k in range(100)], "x long, y long")
    found = components.components(links)
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert len(left) <= 8 and found.count() == 101  # those of the last round at most


def test_components_end_without_a_round_to_confirm(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    links = [(k, 1) for k in range(2, 30)] + [(90, k) for k in range(80, 90)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {k: 1 for k in range(1, 30)} | {k: 80 for k in range(80, 91)}
    assert len(cuts) == 2  # the links, and one round
    path = [(k, k + 1) for k in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(path, "x long, y long")).collect()}
    assert got == {k: 0 for k in range(41)}
    empty = spark.createDataFrame([(3, 3), (None, 4)], "x long, y long")
    assert components.components(empty).count() == 0
