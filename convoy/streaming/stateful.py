"""Keyed state in event-time order: count windows, and the breaker with its episodes, per vehicle.

Rows come in any order, within a micro-batch and across them. Two stateful steps put them right:

1. ``Hold`` keeps the rows of one (shard, range of event time) as state; a shard is a set of vehicles
   that hash alike. When the watermark has passed the range's end, an event-time timer lets them go as
   one packed row: arrays sorted by vehicle and time. A vehicle that sends a third of all rows is spread
   over its ranges here, where the sorting is done.
2. A fold per shard takes the packed rows in the order of their ranges. Ranges that one micro-batch
   lets go end after the watermark of the one before, so order holds across micro-batches too.
   It carries a few numbers per vehicle and works on whole arrays: from one change of state to the
   next, not from row to row.

Calls to the state store cost milliseconds each. Their number goes by shards and ranges, not by vehicles:
a vehicle is an entry of its shard's arrays. ``SHARDS`` is fixed while a stream lives, as its state is keyed
by it; a shard's entries are rewritten by every micro-batch that brings rows of it.

What a task holds is bounded by what the source lets into a micro-batch and by the ranges that the
watermark's delay keeps open. Rows that come later than the delay are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convoy.functions import policy as rules
from convoy.operators.breaker import CLOSED, OPEN, STATE_CODES, Breaker, replay_run
from convoy.settings import BreakerSettings, PolicySettings, QaSettings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "released_at"
# Sets of vehicles that share state entries.
SHARDS = 256


def use_state_store(spark) -> None:
    """Keep state in RocksDB: it is checkpointed incrementally and may exceed memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- Rows held until the watermark ---------------------------------------------------------------


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
}


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


class Hold(StatefulProcessor):
    """Holds the rows of a (shard, range) and lets them go sorted, as one row of arrays.

    A row without ``by[-1]`` only moves the clock and is not held. The packed row names every vehicle
    once, with the number of its rows; the other arrays have one entry per row, vehicle after vehicle.
    """

    def __init__(self, columns: list[str], types: list[str], by: list[str]) -> None:
        self.columns, self.types, self.by = columns, types, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        fields = [("vehicle_id", pa.string()), *((c, _ARROW[t]) for c, t in zip(self.columns, self.types, strict=True))]
        self.schema = pa.schema(fields)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        some = False
        for part in rows:
            part = part[part[self.by[-1]].notna()]
            if len(part):
                # One state entry per batch of rows, not per row.
                table = pa.Table.from_pandas(part[self.schema.names], self.schema, preserve_index=False)
                self.held.appendValue((_stored(table),))
                some = True
        if some:
            self.handle.registerTimer(int(key[1]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        table = pa.concat_tables([pa.ipc.open_stream(rows).read_all() for (rows,) in self.held.get()])
        self.held.clear()
        table = table.sort_by([(c, "ascending") for c in ("vehicle_id", *self.by)]).combine_chunks()
        vehicles = table["vehicle_id"].combine_chunks().dictionary_encode("encode")
        codes = vehicles.indices.to_numpy()
        packed = {c: [table[c].to_numpy()] for c in self.columns}
        yield pd.DataFrame(
            {
                "shard": [key[0]],
                RELEASED: [pd.Timestamp(int(key[1]), unit="ms")],
                "vehicles": [vehicles.dictionary.to_pylist()],
                "n_rows": [np.bincount(codes)],
                **packed,
            }
        )

    def close(self) -> None:
        pass


def in_ranges(rows: DataFrame, types: dict[str, str], by: list[str], width_seconds: int, clock: str) -> DataFrame:
    """Packed rows (shard, released_at, vehicles, n_rows, one array per column of ``types``), a vehicle's
    rows in the order of ``by``.

    ``rows`` has ``at_us`` (microseconds of event time); ``clock`` is its column with a watermark.
    """
    width = width_seconds * 1000
    ends = (F.floor(F.col("at_us") / 1000 / width) + 1) * width
    shard = F.pmod(F.xxhash64("vehicle_id"), F.lit(SHARDS)).cast("int")
    schema = f"shard int, {RELEASED} timestamp, vehicles array<string>, n_rows array<bigint>, "
    schema += ", ".join(f"{c} array<{t}>" for c, t in types.items())
    return (
        rows.select(shard.alias("shard"), "vehicle_id", clock, *types, ends.cast("long").alias("range_ms"))
        .groupBy("shard", "range_ms")
        .transformWithStateInPandas(
            Hold(list(types), list(types.values()), by), schema, outputMode="Append", timeMode="EventTime",
            eventTimeColumnName=RELEASED,
        )
    )


def _joined(parts: pd.DataFrame, columns: list[str]) -> list[np.ndarray]:
    """The arrays of packed rows one after the other."""
    return [np.concatenate([np.asarray(v) for v in parts[c]]) for c in columns]


def _by_vehicle(rows: Iterator[pd.DataFrame], columns: list[str]) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """A shard's vehicles, the number of rows of each, and the arrays vehicle after vehicle, in order of time."""
    parts = pd.concat(list(rows)).sort_values(RELEASED)
    numbers: dict[Any, int] = {}
    named = [numbers.setdefault(v, len(numbers)) for vehicles in parts["vehicles"] for v in vehicles]
    codes = np.repeat(named, np.concatenate(list(parts["n_rows"])))
    # The sort is stable: what stood in order of the ranges stays so.
    order = np.argsort(codes, kind="stable")
    return list(numbers), np.bincount(codes), [c[order] for c in _joined(parts, columns)]


# --- Count windows -------------------------------------------------------------------------------

COUNT_WINDOW = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("window_no", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("quarantined", T.LongType()),
        T.StructField("quarantine_rate", T.DoubleType()),
        T.StructField("exceeded", T.BooleanType()),
        T.StructField("window_end", T.TimestampType()),
    ]
)


class CountWindows(StatefulProcessor):
    """Closes a window for every ``window_size`` outcomes of a vehicle.

    The state is three numbers a vehicle, as arrays over the shard's vehicles: the open window's number,
    its outcomes so far, and those quarantined.
    """

    def __init__(self, qa: QaSettings) -> None:
        self.qa = qa

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState(
            "open", "vehicles array<string>, window_no array<bigint>, total array<bigint>, quarantined array<bigint>"
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names, *numbers = self.open.get() if self.open.exists() else ([], [], [], [])
        known = dict(zip(names, zip(*numbers, strict=True), strict=True))
        vehicles, n_rows, (at_us, bad) = _by_vehicle(rows, ["at_us", "bad"])
        window_no, total, quarantined = np.array([known.get(v, (0, 0, 0)) for v in vehicles], dtype=np.int64).T
        size = self.qa.window_size
        ends = np.cumsum(n_rows)
        begins = ends - n_rows
        owner = np.repeat(np.arange(len(vehicles)), n_rows)
        # Every row's place, counted from the first row of its vehicle's open window.
        place = total[owner] + np.arange(len(owner)) - begins[owner]
        upto = np.append(0, np.cumsum(bad.astype(np.int64)))
        closing = np.flatnonzero((place + 1) % size == 0)
        # What has been quarantined before a window's first row, the open window's share taken off.
        before = upto[begins] - quarantined
        of = owner[closing]
        again = np.append(False, of[1:] == of[:-1])[: len(of)]
        counts = upto[closing + 1] - np.where(again, np.append(0, upto[closing + 1])[: len(of)], before[of])
        rates = counts / size
        last = before.copy()
        last[of] = upto[closing + 1]  # of several closing rows of a vehicle the last one holds
        after = (window_no + (total + n_rows) // size, (total + n_rows) % size, upto[ends] - last)
        known.update(zip(vehicles, zip(*(a.tolist() for a in after), strict=True), strict=True))
        self.open.update((list(known), *[list(a) for a in zip(*known.values(), strict=True)]))
        yield pd.DataFrame(
            {
                "vehicle_id": np.array(vehicles, dtype=object)[of],
                "window_no": window_no[of] + place[closing] // size,
                "total": size,
                "quarantined": counts,
                "quarantine_rate": [round(r, 6) for r in rates.tolist()],
                "exceeded": rates > self.qa.rate_threshold,
                "window_end": pd.to_datetime(at_us[closing].astype(np.int64), unit="us"),
            }
        )

    def close(self) -> None:
        pass


def count_windows(
    outcomes: DataFrame, qa: QaSettings = QaSettings(), width_seconds: int = 3600, clock: str = "event_time"
) -> DataFrame:
    """Streaming counterpart of the batch count windows.

    ``outcomes`` has vehicle_id, event_time, event_id and bad, and a watermark on ``clock``, which is
    not behind ``event_time``. A row without event_id only moves the clock.
    """
    # Numbers are ordered as such, other ids as text.
    kind = "bigint" if dict(outcomes.dtypes)["event_id"] in ("bigint", "int") else "string"
    rows = outcomes.select(
        "vehicle_id", clock, F.unix_micros("event_time").alias("at_us"), F.col("event_id").cast(kind).alias("id"), "bad"
    )
    held = in_ranges(rows, {"at_us": "bigint", "id": kind, "bad": "boolean"}, ["at_us", "id"], width_seconds, clock)
    return held.groupBy("shard").transformWithStateInPandas(
        CountWindows(qa), COUNT_WINDOW, outputMode="Append", timeMode="EventTime"
    )


# --- The breaker and its episodes ----------------------------------------------------------------

_EVENT = {
    "at_us": "bigint", "kind": "int", "ref": "string", "quarantine_rate": "double", "exceeded": "boolean",
    "drift_count": "bigint",
}
# The episode a transition belongs to, as it stands after it; null for other events.
EPISODE = [
    "episode_first_us", "episode_last_us", "episode_retrips", "last_rate", "last_batches", "last_streak", "last_drift",
]
_CORRELATED = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("ref", T.StringType()),
        T.StructField("rolling_rate", T.DoubleType()),
        T.StructField("batch_count", T.LongType()),
        T.StructField("streak", T.LongType()),
        T.StructField("drift_count", T.LongType()),
        T.StructField("prior_state", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("tripped", T.BooleanType()),
        T.StructField("recovered", T.BooleanType()),
        T.StructField("trip_count", T.LongType()),
        T.StructField("first_trip", T.TimestampType()),
        T.StructField("retrip_count", T.LongType()),
        *[T.StructField(c, T.DoubleType() if c == "last_rate" else T.LongType()) for c in EPISODE],
    ]
)
# The state variable that ``live_breakers`` reads: the breakers of a shard's vehicles.
BREAKER = "breaker"
_STATE = (
    "vehicle_id string, rates array<double>, streak bigint, kind string, opened_us bigint, successes int, trip_count bigint, "
    "last_us bigint, " + ", ".join(f"{c} {'double' if c == 'last_rate' else 'bigint'}" for c in EPISODE)
)
_NAMES = np.array([k for k, _ in sorted(STATE_CODES.items(), key=lambda x: x[1])], dtype=object)


def _rolled(rates: list[float], new: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean rate over the last ``reach`` windows and how many there are, after every new window."""
    known = np.concatenate([np.zeros(reach - len(rates)), rates, new])
    total = np.zeros(len(new))
    # Oldest first, as the batch job adds them.
    for back in range(reach - 1, -1, -1):
        total = total + known[reach - back : reach - back + len(new)]
    seen = np.minimum(len(rates) + 1 + np.arange(len(new)), reach)
    return total / seen, seen


def _streaks(streak: int, exceeded: np.ndarray) -> np.ndarray:
    """Consecutive exceeded windows up to every window."""
    place = np.arange(len(exceeded))
    last_good = np.maximum.accumulate(np.where(exceeded, -1 - streak, place))
    return place - last_good


class Correlator(StatefulProcessor):
    """Rolling quality, breaker and open episode of a shard's vehicles over QA batches and drift reports."""

    def __init__(self, policy: PolicySettings, cfg: BreakerSettings) -> None:
        self.policy, self.cfg = policy, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(BREAKER, f"vehicles array<struct<{_as_fields(_STATE)}>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        states = {v[0]: tuple(v) for v in self.held.get()[0]} if self.held.exists() else {}
        vehicles, n_rows, (at_us, kind, ref, rate, exceeded, drift) = _by_vehicle(rows, list(_EVENT))
        at_us, drift, kind = at_us.astype(np.int64), drift.astype(np.int64), kind.astype(np.int32)
        rate, exceeded = rate.astype(float), exceeded.astype(bool)
        ends = np.cumsum(n_rows).tolist()
        told = []
        for vehicle, begin, end in zip(vehicles, [0, *ends], ends):
            own = slice(begin, end)
            new = (vehicle, [], 0, CLOSED, 0, 0, 0, 0, *[None] * len(EPISODE))
            states[vehicle], seen = self._one(
                states.get(vehicle, new), at_us[own], kind[own] == 0, rate[own], exceeded[own], drift[own]
            )
            told.append(seen)
        self.held.update((list(states.values()),))
        mean, count, run, trip_count = (np.concatenate(c) for c in zip(*(t[:4] for t in told), strict=True))
        prior, after, _, tripped, recovered = (np.concatenate(c) for c in zip(*(t[4] for t in told), strict=True))
        firsts, retrips, *marks = ([v for c in column for v in c] for column in zip(*(t[5] for t in told), strict=True))
        yield pd.DataFrame(
            {
                "vehicle_id": np.repeat(np.array(vehicles, dtype=object), n_rows),
                "event_time": pd.to_datetime(at_us, unit="us"),
                "kind": kind,
                "ref": ref,
                "rolling_rate": mean,
                "batch_count": count.astype(np.int64),
                "streak": run.astype(np.int64),
                "drift_count": drift,
                "prior_state": _NAMES[prior],
                "state": _NAMES[after],
                "tripped": tripped,
                "recovered": recovered,
                "trip_count": trip_count,
                "first_trip": pd.to_datetime(pd.Series(firsts, dtype="Int64"), unit="us"),
                "retrip_count": retrips,
                **{
                    c: pd.Series(v, dtype="Float64" if c == "last_rate" else "Int64")
                    for c, v in zip(EPISODE, marks, strict=True)
                },
            }
        )

    def _one(
        self, state: tuple, at_us: np.ndarray, batch: np.ndarray, rate: np.ndarray, exceeded: np.ndarray, drift: np.ndarray
    ) -> tuple[tuple, tuple]:
        """The state of one vehicle after its new events, and what is told of each of them."""
        vehicle, rates, streak, kind_now, opened, successes, trips, _, *episode = state
        known = list(rates)
        means, seen = _rolled(known, rate[batch], self.policy.window_batches)
        streaks = _streaks(streak, exceeded[batch])
        # What stood before the first new window, and then after each one.
        before = _mean(known), len(known), streak
        latest = np.cumsum(batch)
        mean, count, run = (np.append(b, new)[latest] for b, new in zip(before, (means, seen, streaks), strict=True))
        p = self.policy
        trip = ((count >= p.window_batches) & (mean > p.rate_threshold)) | (drift >= p.drift_min_features)
        trip |= run >= p.consecutive_max
        done, after = replay_run(Breaker(kind_now, opened, successes), at_us, trip, self.cfg)
        told, episode = _episodes(episode, at_us, done, mean, count, run, drift)
        trip_count = trips + np.cumsum(done.tripped)
        rates = [*known, *rate[batch].tolist()][-p.window_batches :]
        state = (vehicle, rates, int(run[-1]), after.kind, int(after.opened_us), int(after.successes),
                 int(trip_count[-1]), int(at_us[-1]), *episode)
        return state, (mean, count, run, trip_count, done, told)

    def close(self) -> None:
        pass


def _as_fields(columns: str) -> str:
    """``name type`` pairs as fields of a struct."""
    return ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))


def _mean(rates: list[float]) -> float:
    total = 0.0
    for rate in rates:
        total += rate
    return total / len(rates) if rates else 0.0


def _episodes(episode: list, at_us: np.ndarray, done: Any, *figures: np.ndarray) -> tuple[list[list], list]:
    """First trip and retrips after every event with the episode at every transition, and the one open at the end.

    Only transitions are looped over; a breaker that stays open costs nothing here.
    """
    n = len(at_us)
    changes = [(0, episode[0], episode[2] or 0)]
    marks: list[list] = [[None] * n for _ in EPISODE]
    for i in np.flatnonzero(done.tripped | done.recovered).tolist():
        if done.tripped[i]:
            at = int(at_us[i])
            known = [f[i].item() for f in figures]
            again = episode[0] is not None
            episode = [episode[0] if again else at, at, episode[2] + 1 if again else 0, *known]
        for mark, value in zip(marks, episode, strict=True):
            mark[i] = value
        if done.recovered[i]:
            episode = [None] * len(EPISODE)
        changes.append((i, episode[0], episode[2] or 0))
    firsts, retrips = [], []
    for (begin, first, again), end in zip(changes, [*(i for i, _, _ in changes[1:]), n]):
        firsts += [first] * (end - begin)
        retrips += [again] * (end - begin)
    return [firsts, retrips, *marks], episode


def correlate(
    windows: DataFrame,
    incidents: DataFrame,
    policy: PolicySettings = PolicySettings(),
    cfg: BreakerSettings = BreakerSettings(),
    width_seconds: int = 86_400,
) -> DataFrame:
    """Streaming counterpart of the batch breaker: one row per evaluated event, in event-time order.

    Both inputs are streams with a watermark, on ``window_end`` and ``event_time``; the engine goes by
    the slower one, so a range is evaluated when both have passed it. Rows without ``window_no`` or
    ``incident_id`` only move the clock. The policy's reasons, severity and route are projected after
    the state operator by the column expressions that the batch job uses.
    """
    batches = windows.select(
        "vehicle_id",
        F.col("window_end").alias("event_time"),
        F.lit(0).alias("kind"),
        F.lpad(F.col("window_no").cast("string"), 12, "0").alias("ref"),
        "quarantine_rate",
        "exceeded",
        F.lit(0).cast("long").alias("drift_count"),
    )
    reports = incidents.select(
        rules.incident_vehicle(F.col("vehicle_id")).alias("vehicle_id"),
        "event_time",
        F.lit(1).alias("kind"),
        F.col("incident_id").alias("ref"),
        F.lit(0.0).alias("quarantine_rate"),
        F.lit(False).alias("exceeded"),
        rules.incident_drift_count(F.col("observed_value"), F.col("drifted_features")).alias("drift_count"),
    )
    rows = batches.unionByName(reports).withColumn("at_us", F.unix_micros("event_time"))
    held = in_ranges(rows, _EVENT, ["at_us", "kind", "ref"], width_seconds, "event_time")
    evaluated = held.groupBy("shard").transformWithStateInPandas(
        Correlator(policy, cfg), _CORRELATED, outputMode="Append", timeMode="EventTime"
    )
    return rules.decide(evaluated, policy)


def live_breakers(spark, checkpoint: str, as_of: Column, cfg: BreakerSettings = BreakerSettings()) -> DataFrame:
    """The breaker of every vehicle out of the running stream's state, as of an instant after its last event.

    Read from the checkpoint by the engine's state reader; the cooldown is applied at reading time.
    """
    operators = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorProperties").contains(f'"{BREAKER}"'))
    operator = operators.agg(F.max("operatorId")).first()[0]
    state = (
        spark.read.format("statestore")
        .option("operatorId", operator)
        .option("stateVarName", BREAKER)
        .load(checkpoint)
        .select(F.inline("value.vehicles"))
    )
    cooled = F.unix_micros(as_of) - F.col("opened_us") >= F.lit(int(cfg.cooldown_seconds * 1_000_000))
    shown = F.when((F.col("kind") == OPEN) & cooled, "half_open").otherwise(F.col("kind"))
    code = F.lit(None).cast("int")
    for name, value in STATE_CODES.items():
        code = F.when(F.col("state") == name, value).otherwise(code)
    return state.where(F.col("last_us") <= F.unix_micros(as_of)).withColumn("state", shown).select(
        "vehicle_id",
        "state",
        code.alias("state_code"),
        "trip_count",
        F.timestamp_micros("last_us").alias("last_event"),
        F.when(F.col("kind") == OPEN, F.timestamp_micros("opened_us")).alias("opened_at"),
    )


