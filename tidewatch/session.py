"""Spark session defaults shared by the library, tests and the bench.

On a cluster the session already exists and carries the cluster's settings; `configure` only fills in
what is unset (UTC session zone, AQE, Arrow, a checkpoint folder for tests).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package relies on. AQE re-plans joins from runtime sizes, coalesces
# small shuffle partitions and splits skewed ones; the UTC zone makes every timestamp comparison
# independent of the machine.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidewatch", driver_memory: str = "16g") -> SparkSession:
    """Session for local runs (tests, bench). Clusters pass their own builder config."""
    builder = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
               .config("spark.driver.memory", driver_memory))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the package defaults to an existing session without overriding explicit settings.

    The one exception is the session time zone: every stored timestamp and every date boundary of
    the domain is defined in UTC (the raw event times are zone-less), so results must not depend
    on the zone a caller's session happens to carry.
    """
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage in iterative operators.

    Reads `spark.checkpoint.dir` from the session: a cluster names a shared, fault-tolerant folder
    there, and without one this fails, as files on one machine's disk are lost to the others. Only a
    session whose executors are this very process (local tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tidewatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return sc.getCheckpointDir() or local


def cut_lineage(df):
    """Materialise `df` with a reliable checkpoint into the session's checkpoint folder.

    Used where a plan fans out from an expensive node (the Python HTML parse) or loops (iterative
    folds): the result survives executor loss and is computed once. Never `localCheckpoint`.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
