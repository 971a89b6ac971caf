"""A message log: partitions of records with dense offsets, kept as segment files, and a stream over it.

``append`` writes records in their order of arrival. A segment is a file of consecutive offsets of
one partition, named by its first offset. ``stream`` reads the log as a source of its own with
(partition, offset), so a query continues where its checkpoint says, a replayed micro-batch reads
the very records it read before, and ``partition`` and ``offset`` name a record (``coerce.record_key``).

A micro-batch takes about ``per_trigger`` records, dealt to partitions in proportion to what they have
left, so that they go forward at one pace in time. The place up to which offsets
have been handed out is kept in ``progress``, a folder of the query beside its checkpoint; after a
restart the source repeats that place first, which is at or beyond all that the checkpoint holds.

Segments are read by range on the executors. The log may lie in any store that Arrow's file systems
reach.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from convoy.operators import scan

FORMAT = "message_log"
SCHEMA = "partition int, offset long, sent_at timestamp, value string"
_ARROW = pa.schema(
    [("partition", pa.int32()), ("offset", pa.int64()), ("sent_at", pa.timestamp("us", tz="UTC")), ("value", pa.string())]
)
DIGITS = 19


def append(records: DataFrame, path: str, key: Column, order: Sequence[str], partitions: int = 4, segment: int = 100_000) -> None:
    """Add ``records`` (sent_at, value, and the columns of ``order``) to the log at ``path``.

    Records of one ``key`` go to one partition. ``order`` is their order of arrival there, unique.
    """
    spark = records.sparkSession
    dealt = records.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
    numbered = scan.keyed_sequence(dealt, ["partition"], list(order), name="offset")
    begun = {int(p): end for p, end in ends(path).items()}
    if begun:
        first = F.create_map(*[F.lit(x) for pair in begun.items() for x in pair])
        numbered = numbered.withColumn("offset", F.col("offset") + F.coalesce(first[F.col("partition")], F.lit(0)))
    # A segment's name is its first offset: a multiple of its size, or where this call begins.
    start = F.lit(0) if not begun else F.coalesce(first[F.col("partition")], F.lit(0))
    at = F.greatest(F.col("offset") - F.col("offset") % segment, start)
    (
        numbered.select("partition", F.lpad(at.cast("string"), DIGITS, "0").alias("segment"), "offset", "sent_at", "value")
        .repartition("partition", "segment")
        .sortWithinPartitions("partition", "segment", "offset")
        .write.mode("append")
        .partitionBy("partition", "segment")
        .parquet(path)
    )
    spark.catalog.refreshByPath(path)


class Segment(NamedTuple):
    first: int
    end: int
    path: str


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


class Listing:
    """The segments of a log; files are looked into once."""

    def __init__(self, path: str) -> None:
        self.store, self.root = _store(path)
        self.known: dict[str, Segment] = {}

    def segments(self) -> dict[int, list[Segment]]:
        """Per partition the segments that follow one another without a gap, from the first."""
        found: dict[int, list[Segment]] = {}
        files = self.store.get_file_info(pyarrow.fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        for file in files:
            folders = dict(x.split("=", 1) for x in file.path.split("/") if "=" in x)
            if not file.path.endswith(".parquet") or "segment" not in folders or "_temporary" in file.path:
                continue
            if file.path not in self.known:
                first = int(folders["segment"])
                with self.store.open_input_file(file.path) as opened:
                    self.known[file.path] = Segment(first, first + pq.ParquetFile(opened).metadata.num_rows, file.path)
            found.setdefault(int(folders["partition"]), []).append(self.known[file.path])
        return {p: _without_gaps(sorted(s)) for p, s in found.items()}

    def ends(self) -> dict[str, int]:
        return {str(p): s[-1].end for p, s in sorted(self.segments().items()) if s}


def _without_gaps(segments: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for s in segments:
        if s.first != (out[-1].end if out else 0):
            break
        out.append(s)
    return out


def ends(path: str) -> dict[str, int]:
    """Per partition the offset after its last record."""
    return Listing(path).ends()


class Slice(InputPartition):
    """Records ``first`` to ``end`` of a segment."""

    def __init__(self, partition: int, path: str, begins: int, first: int, end: int) -> None:
        self.partition, self.path, self.begins, self.first, self.end = partition, path, begins, first, end


class MessageLog(DataSource):
    """``spark.readStream.format("message_log")`` with options path, per_trigger and progress."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogReader(self.options["path"], int(self.options["per_trigger"]), self.options["progress"])


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, per_trigger: int, progress: str) -> None:
        self.listing, self.per_trigger = Listing(path), per_trigger
        self.progress_store, self.progress = _store(progress)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far the next micro-batch may read."""
        if self.at is None:
            self.at = self._kept()
            if self.at:
                return self.at
        there = self.listing.ends()
        left = {p: max(0, end - self.at.get(p, 0)) for p, end in there.items()}
        share = min(1.0, self.per_trigger / max(1, sum(left.values())))
        self.at = {p: self.at.get(p, 0) + math.ceil(n * share) for p, n in left.items()}
        self._keep(self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for partition, segments in self.listing.segments().items():
            first, last = start.get(str(partition), 0), end.get(str(partition), 0)
            for s in segments:
                if s.first < last and s.end > first:
                    out.append(Slice(partition, s.path, s.first, max(first, s.first), min(last, s.end)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        at = partition.begins
        with self.listing.store.open_input_file(partition.path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(columns=["offset", "sent_at", "value"], use_threads=False):
                low, high = max(partition.first - at, 0), min(partition.end - at, batch.num_rows)
                at += batch.num_rows
                if low < high:
                    part = batch.slice(low, high - low)
                    columns = [part.column(c) for c in part.schema.names]
                    sent = pc.cast(columns[1], pa.timestamp("us"), safe=False).cast(_ARROW.field("sent_at").type)
                    number = pa.array([partition.partition] * len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays([number, columns[0], sent, columns[2]], schema=_ARROW)
                if at >= partition.end:
                    return

    def _kept(self) -> dict[str, int]:
        file = f"{self.progress}/handed-out.json"
        if self.progress_store.get_file_info(file).type == pyarrow.fs.FileType.NotFound:
            return {}
        with self.progress_store.open_input_stream(file) as opened:
            return json.loads(opened.read())

    def _keep(self, place: dict[str, int]) -> None:
        self.progress_store.create_dir(self.progress, recursive=True)
        with self.progress_store.open_output_stream(f"{self.progress}/next.json") as opened:
            opened.write(json.dumps(place).encode())
        # The move is what makes the new place hold, so a reader never sees half of it.
        self.progress_store.move(f"{self.progress}/next.json", f"{self.progress}/handed-out.json")


def stream(spark: SparkSession, path: str, per_trigger: int, progress: str) -> DataFrame:
    """The log as a stream, about ``per_trigger`` records a micro-batch, from the first one on."""
    spark.dataSource.register(MessageLog)
    options = {"path": path, "per_trigger": str(per_trigger), "progress": progress}
    return spark.readStream.format(FORMAT).options(**options).load()
