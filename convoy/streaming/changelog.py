"""A keyed table kept by a stream: a log of row versions, compacted into snapshots.

Every micro-batch writes the versions it makes, whole rows, below its own id; a micro-batch that is
replayed replaces what it wrote, so the log holds each version once. A version column orders the
versions of a key. The table is the newest version of every key in the latest snapshot and the
log after it. ``compact`` makes that the next snapshot; it reads the log of the finished micro-batches
and never changes what ``read`` returns.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.session import children, delete

BATCH = "batch_id"


def append(versions: DataFrame, path: str, batch_id: int) -> None:
    """Write the versions that micro-batch ``batch_id`` makes."""
    versions.write.mode("overwrite").parquet(os.path.join(path, "log", f"{BATCH}={batch_id}"))


def _numbered(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """The finished folders ``name=N`` below ``path``, by N."""
    found = {}
    for child in children(spark, path):
        match = re.fullmatch(rf"{name}=(\d+)", os.path.basename(child))
        if match and any(os.path.basename(f) == "_SUCCESS" for f in children(spark, child)):
            found[int(match[1])] = child
    return found


def newest(versions: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The newest version of every key: a partial aggregate, so a key of many versions is no group."""
    row = F.struct(*[F.col(c) for c in versions.columns])
    return versions.groupBy(key).agg(F.max_by(row, F.struct(*version)).alias("_row")).select("_row.*")


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int, int]:
    """What to read, the last micro-batch in it, and the one up to which the snapshot goes."""
    snapshots = _numbered(spark, os.path.join(path, "snapshots"), "upto")
    upto = max(snapshots, default=-1)
    batches = {n: p for n, p in _numbered(spark, os.path.join(path, "log"), BATCH).items() if n > upto}
    return [*([snapshots[upto]] if snapshots else []), *batches.values()], max(batches, default=upto), upto


def read(spark: SparkSession, path: str, schema: str, key: str, version: list[str]) -> DataFrame:
    """The table as of the last finished micro-batch."""
    paths, _, _ = _parts(spark, path)
    if not paths:
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(*paths), key, version)


def compact(spark: SparkSession, path: str, schema: str, key: str, version: list[str]) -> None:
    """Make the table so far the next snapshot, and delete the log that the snapshot before it holds.

    The log since that one stays until the next call, for readers that have listed it.
    """
    paths, last, before = _parts(spark, path)
    if last > before:
        target = os.path.join(path, "snapshots", f"upto={last}")
        newest(spark.read.schema(schema).parquet(*paths), key, version).write.mode("overwrite").parquet(target)
    for n, folder in _numbered(spark, os.path.join(path, "log"), BATCH).items():
        if n <= before:
            delete(spark, folder)
    for n, folder in _numbered(spark, os.path.join(path, "snapshots"), "upto").items():
        if n < before:
            delete(spark, folder)
