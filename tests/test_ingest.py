"""Keyed-mutation helpers on hand-written rows."""

from pyspark.sql import functions as F

from tidewatch.operators import ingest as A


def test_assign_ids_dense_and_ordered_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = A.assign_ids(df, 41, [F.col("k")]).collect()
    by_k = sorted(out, key=lambda r: r.k)
    assert [r.id for r in by_k] == list(range(42, 1042))


def test_upsert_and_insert_ignore(spark):
    cur = spark.createDataFrame([("E0", "a", "old", "h1", "t1"), ("E0", "b", "keep", "h2", "t1")],
                                "entity string, page_key string, content_text string, content_hash string, updated_at string")
    upd = spark.createDataFrame([("E0", "a", "x" * 200_005, "hfull", "t2"), ("E1", "a", "new", "h3", "t2")],
                                "entity string, page_key string, content_text string, content_hash string, updated_at string")
    got = {(r.entity, r.page_key): (len(r.content_text), r.content_hash) for r in A.upsert(cur, upd, ["entity", "page_key"]).collect()}
    assert got == {("E0", "a"): (200_000, "hfull"), ("E0", "b"): (4, "h2"), ("E1", "a"): (3, "h3")}
    stored = spark.createDataFrame([("E0", "u1")], "entity string, url string")
    batch = spark.createDataFrame([(1, "E0", "u1"), (2, "E0", "u2"), (3, "E0", "u2"), (4, "E1", "u1")], "id long, entity string, url string")
    ins = sorted(r.id for r in A.insert_ignore(stored, batch, ["entity", "url"], [F.col("id")]).collect())
    assert ins == [2, 4]


def test_backfill_variants(spark):
    cur = spark.createDataFrame([(1, "E0")], "id long, entity string")
    seed = spark.createDataFrame([(10, "E0"), (11, "E1"), (12, "E1")], "id long, entity string")
    assert sorted(r.id for r in A.backfill(cur, seed).collect()) == [1, 11, 12]
    assert sorted(r.id for r in A.backfill(cur, seed, only_if_empty=True).collect()) == [1]
    empty = cur.filter("id < 0")
    assert sorted(r.id for r in A.backfill(empty, seed, only_if_empty=True).collect()) == [10, 11, 12]


def test_shorten_description(spark):
    words = " ".join(["word"] * 60)
    df = spark.createDataFrame([(words,), ("short\ntext",), ("x" * 250,)], "d string")
    got = [r.s for r in df.select(A.shorten_description(F.col("d")).alias("s")).collect()]
    want = []
    for d in [words, "short\ntext", "x" * 250]:
        t = d.strip().replace("\n", " ")
        want.append(t[:200].rsplit(" ", 1)[0] + "…" if len(t) > 200 else t)
    assert got == want


def test_checked_load_counts_while_it_writes(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "2024-01-01"), (None, "bad"), ("4", None)] * 50, "a string, b string")
    loaded, counts = A.load_checked(df, {"a": "int", "b": "date"}, f"{tmp_path}/t")
    assert counts == {"total": 200, "failed": 100, "loaded": 100}
    assert sorted({(r.a, str(r.b)) for r in loaded.collect()}) == [(1, "2024-01-01"), (4, "None")]
    _, counts = A.load_checked(df.limit(0), {"a": "int"}, f"{tmp_path}/none")
    assert counts == {"total": 0, "failed": 0, "loaded": 0}


def test_ledger_updates_a_stored_run(spark):
    runs = spark.createDataFrame([(1, "s1", "f1"), (2, "s2", "f2"), (None, "s0", "f0")], "run_id long, at string, done string")
    errors = spark.createDataFrame([(2, k, f"e{k}") for k in range(250)], "run_id long, seq long, error string")
    ledger = A.ledger_rows(runs, "start", "at").unionByName(A.ledger_rows(errors, "error", seq="seq", text="error"))
    assert {r.status for r in A.run_states(ledger).collect()} == {"running"}
    ledger = ledger.unionByName(A.ledger_rows(runs.where("run_id is not null"), "finish", "done"))
    assert {r.run_id: (r.status, r.n_errors) for r in A.run_states(ledger).collect()} == {
        1: ("completed", 0), 2: ("completed_with_errors", 250), None: ("running", 0)}
    assert [(r.no, r.error) for r in A.run_errors(ledger).orderBy("no").collect()] == [(k + 1, f"e{k}") for k in range(250)]
    texts = [r.details for r in A.error_texts(ledger).orderBy("chunk").collect()]
    assert "; ".join(texts) == "; ".join(f"e{k}" for k in range(250)) and len(texts) == 3
