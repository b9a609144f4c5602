"""Streaming forms equal their batch operators."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewatch.operators import ingest as A
from tidewatch.operators import similarity as C
from tidewatch.sources import tables as T
from tidewatch.streaming import streams as S

from conftest import SF_SMALL


def _dir(tag):
    return tempfile.mkdtemp(prefix=f"tw-{tag}-", dir="/tmp")


def test_snapshot_stream_matches_sequential(spark):
    src = _dir("s1src")
    rows = [("E0", "p1", 1, "h1"), ("E0", "p1", 2, "h1"), ("E0", "p2", 3, "h9"), ("E0", "p1", 4, "h2")]
    # one file per micro-batch, so arrival order is the file order
    spark.createDataFrame(rows[:2], "entity string, page_key string, seq long, content_hash string").coalesce(1).write.parquet(f"{src}/a")
    spark.createDataFrame(rows[2:], "entity string, page_key string, seq long, content_hash string").coalesce(1).write.parquet(f"{src}/b")
    stream = spark.readStream.schema("entity string, page_key string, seq long, content_hash string").option(
        "maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = _dir("s1out"), _dir("s1ck")
    q = S.snapshot_stream(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.seq: r.status for r in spark.read.parquet(out).collect()}
    assert got == {1: "baseline", 2: "unchanged", 3: "baseline", 4: "changed"}


def test_insert_ignore_stream_equals_batch(spark):
    n = T.news(T.Raw(spark, SF_SMALL)).select("id", "entity", "url", (F.col("id") % 7).alias("slot"))
    n = n.withColumn("link", F.concat(F.lit("l"), (F.col("id") % 11).cast("string")))
    src = _dir("s2src")
    n.filter("id % 2 = 0").coalesce(1).write.parquet(f"{src}/a")
    n.filter("id % 2 = 1").coalesce(1).write.parquet(f"{src}/b")
    schema = "id long, entity string, url string, slot long, link string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    table, ck = _dir("s2tab"), _dir("s2ck")
    q = S.insert_ignore_stream(stream, table, ["entity", "link"], "id", schema).option(
        "checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.id for r in spark.read.parquet(table).collect()}
    # sequential model: batches in file order, each batch against everything stored before it
    stored = set()
    want = set()
    for part in ("a", "b"):
        batch = sorted((r.id, r.entity, r.link) for r in spark.read.parquet(f"{src}/{part}").collect())
        seen = set()
        for i, e, link in batch:
            if (e, link) in stored or (e, link) in seen:
                continue
            seen.add((e, link))
            want.add(i)
        stored |= seen
    assert got == want
