"""Registered queries for the streaming forms.

Each query lays the input rows out as a file source in the session's checkpoint folder (two
arrivals: the first half of the rows, then the rest), runs the stream with availableNow and
returns what the sink wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import pages as P
from ..session import checkpoint_dir
from ..sources import tables as T
from ..streaming import streams as ST
from .registry import query


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex}"


def _two_arrivals(df, path: str, split, start):
    """Write the first rows, run the stream to its end, write the others, run it again: two batches,
    however many files a write makes."""
    for k, rows in enumerate((split, ~split), 1):
        df.filter(rows).write.parquet(f"{path}/src/part={k}")
        start().awaitTermination()


@query("s1_snapshot_stream")
def s1_snapshot_stream(spark, sf_dir):
    """Every watched page arrives twice (its html, then html with a changed title on every third
    page); the state store labels each arrival baseline / unchanged / changed."""
    w = T.watched_pages(T.Raw(spark, sf_dir))
    first = w.select("entity", "page_key", F.col("page_id").alias("seq"), P.S.content_hash(F.col("html")).alias("content_hash"))
    html2 = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<title>", "<title>Updated ")).otherwise(F.col("html"))
    second = w.select("entity", "page_key", (F.col("page_id") + F.lit(1 << 40)).alias("seq"), P.S.content_hash(html2).alias("content_hash"))
    path = _scratch(spark, "s1")
    both = first.unionByName(second)
    schema = "entity string, page_key string, seq long, content_hash string"
    stream = spark.readStream.schema(schema).parquet(f"{path}/src/part=*")
    sink = ST.snapshot_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/ck").trigger(availableNow=True)
    _two_arrivals(both, path, F.col("seq") < F.lit(1 << 40), sink.start)
    return spark.read.schema(ST.SNAPSHOT_OUT).parquet(f"{path}/out")


@query("s2_insert_ignore_stream")
def s2_insert_ignore_stream(spark, sf_dir):
    """News rows arrive in two batches keyed by (entity, canonical link); only new keys are stored."""
    n = T.news(T.Raw(spark, sf_dir)).select(
        "id", "entity", "url", F.concat(F.lit("https://news.example/a/"), (F.col("id") % 200).cast("string")).alias("link"))
    path = _scratch(spark, "s2")
    schema = "id long, entity string, url string, link string"
    stream = spark.readStream.schema(schema).parquet(f"{path}/src/part=*")
    sink = ST.insert_ignore_stream(stream, f"{path}/table", ["entity", "link"], "id", schema).option(
        "checkpointLocation", f"{path}/ck").trigger(availableNow=True)
    _two_arrivals(n, path, F.col("id") % 2 == 0, sink.start)
    return spark.read.parquet(f"{path}/table").select("id", "entity", "link", "batch")


@query("s3_covered_stream")
def s3_covered_stream(spark, sf_dir):
    """Every news headline arrives as a candidate (two batches) and is kept unless a recent stored
    headline of its entity covers it."""
    raw = T.Raw(spark, sf_dir)
    n = T.news(raw)
    path = _scratch(spark, "s3")
    n.write.parquet(f"{path}/stored")
    stream = spark.readStream.schema("id long, entity string, headline string").parquet(f"{path}/src/part=*")
    sink = ST.covered_stream(stream, f"{path}/table", f"{path}/stored", T.as_of(), "id long, entity string, headline string").option(
        "checkpointLocation", f"{path}/ck").trigger(availableNow=True)
    _two_arrivals(n.select("id", "entity", "headline"), path, F.col("id") % 2 == 0, sink.start)
    return spark.read.parquet(f"{path}/table").select("id", "entity", "batch")
