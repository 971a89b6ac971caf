"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone to UTC; all event times are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    On a cluster it has to be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # One machine: any folder of its own is shared.
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is written there goes when the session ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """What lies directly below a folder; nothing if there is no such folder."""
    at, store = _hadoop(spark, path)
    return [f.getPath().toString() for f in store.listStatus(at)] if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, store = _hadoop(spark, path)
    store.delete(at, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    at, store = _hadoop(spark, path)
    store.create(at, True).close()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: one fixed result."""
    path = new_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
