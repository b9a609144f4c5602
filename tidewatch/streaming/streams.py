"""Structured Streaming forms of the scan-to-scan steps, run over file sources.

* S1 keeps the last content hash per (entity, page_key) in Spark's fault-tolerant state store
  (`applyInPandasWithState`): state is one small row per watched page, and every arrival is
  labelled baseline / unchanged / changed against the state, in order of `seq` within a batch; an
  arrival older than the stored snapshot is labelled late and changes nothing.
* S2 and S3 need the rows already stored in a table, so they run as `foreachBatch` sinks that call
  the batch operators (A11, C9) against that table and append with the batch id as the version:
  a replayed batch overwrites its own version, so the sink is idempotent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest as A
from ..operators import similarity as C

SNAPSHOT_OUT = "entity string, page_key string, seq long, content_hash string, status string"
SNAPSHOT_STATE = "content_hash string, seq long"


def _compare_group(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entity, page_key = key
    prev, newest = state.get if state.exists else (None, None)
    rows = pd.concat(list(pdfs)).sort_values("seq").reset_index(drop=True)
    status = []
    for h, seq in zip(rows["content_hash"], rows["seq"]):
        if newest is not None and seq < newest:
            status.append("late")  # older than the stored snapshot, which stays
            continue
        status.append("baseline" if prev is None else ("unchanged" if prev == h else "changed"))
        prev, newest = h, int(seq)
    state.update((prev, newest))
    yield pd.DataFrame({"entity": entity, "page_key": page_key, "seq": rows["seq"].astype("int64"),
                        "content_hash": rows["content_hash"], "status": status})


def snapshot_stream(stream_df: DataFrame) -> DataFrame:
    """Stream of (entity, page_key, seq, content_hash) -> status per arrival."""
    return stream_df.groupBy("entity", "page_key").applyInPandasWithState(
        _compare_group, SNAPSHOT_OUT, SNAPSHOT_STATE, "append", GroupStateTimeout.NoTimeout)


def _append_version(df: DataFrame, table_path: str, batch_id: int) -> None:
    df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")


def _stored(spark: SparkSession, table_path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows stored by earlier batches (a replay of this batch ignores its own earlier output)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):  # no version written yet
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema + ", batch long").parquet(table_path)
    return df.filter(F.col("batch") < batch_id).drop("batch")


def insert_ignore_stream(stream_df: DataFrame, table_path: str, keys: list[str], order: str, schema: str):
    """foreachBatch sink appending only rows whose key is neither stored nor seen earlier in
    the batch (A11)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        stored = _stored(batch.sparkSession, table_path, schema, batch_id)
        _append_version(A.insert_ignore(stored, batch, keys, [F.col(order)]), table_path, batch_id)

    return stream_df.writeStream.foreachBatch(sink)


def covered_stream(stream_df: DataFrame, table_path: str, stored_path: str, as_of, schema: str):
    """S3: foreachBatch sink keeping candidates not covered by the recent stored headlines."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.parquet(stored_path)
        kept = C.drop_covered(batch, stored, as_of)
        _append_version(kept, table_path, batch_id)

    return stream_df.writeStream.foreachBatch(sink)
