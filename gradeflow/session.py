"""Spark session and shared-storage helpers.

Everything that writes intermediate data (sinks, lineage cuts) goes below the
folder the cluster names in ``spark.checkpoint.dir``.  We only pick a folder
ourselves when that setting is absent, which is the case in local tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # runtime broadcast decisions are made by AQE on measured sizes
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "gradeflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the "
                               "driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gradeflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "gradeflow-tables", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), eager."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Lineage cut through a Parquet table below the shared folder, for loops.  A checkpoint hands on the
    optimizer's size estimate, which multiplies with every join of a loop; a table starts from its files' size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "bucketed") -> DataFrame:
    """Lineage cut through a table below the shared folder whose files are buckets of ``keys``: joins by these keys
    don't move its rows.  Rows that are dealt by ``repartition(buckets, *keys)`` go into one file a bucket."""
    path = scratch_path(df.sparkSession, name)
    table = os.path.basename(path).replace("-", "_")
    df.write.bucketBy(buckets, keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
