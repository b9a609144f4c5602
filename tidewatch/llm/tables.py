"""Tables that an operator writes into the session's shared folder, and frees when it needs them no more.

They cut lineage like a checkpoint, but are compressed and columnar, and go when they are freed and not only
when the driver happens to collect its garbage.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table (Parquet) of its own in the shared folder."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._stored_at = folder
    return table


def let_go(spark: SparkSession) -> None:
    """Free the shuffle files of plans that nothing refers to any more. Spark deletes them once the driver's garbage is
    collected, which a driver that only plans seldom does by itself; what a running task reads is still referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage, whatever storage that is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(*tables: DataFrame) -> None:
    """Delete stored tables; nothing may read them any more."""
    for table in tables:
        delete_folder(table.sparkSession, table._stored_at)


def untouched(rows: DataFrame, made: tuple[str, ...], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `choose` leaves, with their own columns as they are, though it makes columns of the names `made`."""
    taken, aside = set(rows.columns) | set(made), {}
    for c in rows.columns:
        if c in made:
            name = f"_{c}"
            while name in taken:
                name = f"_{name}"
            taken.add(name)
            aside[c] = name
    left = choose(rows.withColumnsRenamed(aside))
    return left.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in rows.columns])
