"""Drift windows of a stream: warm-up, a baseline frozen in state, and sliding windows after it.

Records are put in event-time order by ranges (``stateful.in_ranges``), where the sorting is done in
parallel. One small step then sees the ranges in order: it counts, keeps the baseline's rows
until it is complete, and hands on blocks of live rows, each with the rows of the window before it
and with the baseline. It works on whole arrays and scores nothing. Blocks are then dealt over all
tasks and scored by the very function that the batch job uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convoy.operators import drift as batch
from convoy.settings import FEATURES, DriftSettings
from convoy.streaming import stateful

# Live rows per block that is scored by one task, and blocks that are handed on at a time.
BLOCK, BLOCKS = 2_000, 64
FLEET = "fleet"


class Sequence(StatefulProcessor):
    """Numbers the fleet's records, freezes the baseline, and cuts live rows into overlapping blocks.

    The state is a count, the baseline, and the last rows that the next block begins with.
    """

    def __init__(self, drift: DriftSettings, id_type: str) -> None:
        self.drift = drift
        self.columns = {"at_us": "bigint", "id": id_type, **{f: "double" for f in FEATURES}}

    def init(self, handle: StatefulProcessorHandle) -> None:
        base = ", ".join(f"base_{f} array<double>" for f in FEATURES)
        tail = ", ".join(f"tail_{c} array<{t}>" for c, t in self.columns.items())
        self.held = handle.getValueState("sequence", f"seen bigint, {base}, {tail}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n_features, n_columns = len(FEATURES), len(self.columns)
        held = self.held.get() if self.held.exists() else (0, *[[]] * (n_features + n_columns))
        seen, base, tail = held[0], [list(b) for b in held[1 : 1 + n_features]], held[1 + n_features :]
        start, reach = self.drift.warmup + self.drift.baseline, self.drift.window - 1 + self.drift.stride
        for new in _stretches(rows, list(self.columns)):
            n = len(new[0])
            first, last = (min(max(0, x - seen), n) for x in (self.drift.warmup, start))
            for b, values in zip(base, new[2:], strict=True):
                b.extend(values[first:last].tolist())
            live = [np.concatenate([np.asarray(t, dtype=c.dtype), c[last:]]) for t, c in zip(tail, new, strict=True)]
            known, total = len(tail[0]), len(live[0])
            blocks = []
            for at in range(known, total, BLOCK):
                low, high = max(0, at - reach), min(at + BLOCK, total)
                pos = max(0, seen - start) - known + low
                blocks.append((pos, at - low, *[c[low:high] for c in live], *base))
            seen, tail = seen + n, [c[max(0, total - reach) :] for c in live]
            yield pd.DataFrame(blocks, columns=self.block_columns())
        self.held.update((seen, *base, *[t.tolist() for t in tail]))

    def block_columns(self) -> list[str]:
        return ["pos", "n_before", *self.columns, *[f"base_{f}" for f in FEATURES]]

    def block_schema(self) -> str:
        arrays = {**self.columns, **{f"base_{f}": "double" for f in FEATURES}}
        return "pos bigint, n_before bigint, " + ", ".join(f"{c} array<{t}>" for c, t in arrays.items())

    def close(self) -> None:
        pass


def _stretches(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The ranges' arrays in order of time, joined to some blocks' worth of rows."""
    parts = pd.concat(list(rows)).sort_values(stateful.RELEASED)
    taken = np.cumsum([sum(n) for n in parts["n_rows"]]) // (BLOCK * BLOCKS)
    for _, some in parts.groupby(taken):
        yield stateful._joined(some, columns)


def windows(rows: DataFrame, drift: DriftSettings = DriftSettings(), clock: str = "event_time", width_seconds: int = 3600) -> DataFrame:
    """Streaming counterpart of the batch drift windows.

    ``rows`` has event_time, event_id and the features, and a watermark on ``clock``.
    """
    numeric = dict(rows.dtypes)["event_id"] in ("bigint", "int")
    sequence = Sequence(drift, "bigint" if numeric else "string")
    narrow = rows.select(
        F.lit(FLEET).alias("vehicle_id"),
        clock,
        F.unix_micros("event_time").alias("at_us"),
        F.col("event_id").cast(sequence.columns["id"]).alias("id"),
        *[F.col(f).cast("double").alias(f) for f in FEATURES],
    )
    # A record's id is what ties are ordered by, and a record without one only moves the clock.
    ordered = ["at_us", "id"]
    held = stateful.in_ranges(narrow, sequence.columns, ordered, width_seconds, clock)
    blocks = held.groupBy("shard").transformWithStateInPandas(
        sequence, sequence.block_schema(), outputMode="Append", timeMode="EventTime"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for k in range(len(held)):
                block = {c: held[c][k].values for c in (*sequence.columns, *(f"base_{f}" for f in FEATURES))}
                base = np.column_stack([block[f"base_{f}"].to_numpy(zero_copy_only=False) for f in FEATURES])
                n = len(block["at_us"])
                table = pa.table(
                    {
                        "pos": held["pos"][k].as_py() + np.arange(n),
                        "event_time": block["at_us"].cast(pa.timestamp("us", "UTC")),
                        "event_id": block["id"],
                        **{f: block[f] for f in FEATURES},
                        "_own": np.arange(n) >= held["n_before"][k].as_py(),
                    }
                )
                yield from batch.scorer(base, numeric, drift)(table).to_batches()

    # One task has made all blocks; from here on they are scored apart.
    return blocks.repartition("pos").mapInArrow(score, batch.result_ddl(numeric))
