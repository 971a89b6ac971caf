"""Per-vehicle circuit breaker over policy decisions, and its snapshot.

The breaker is a fold over a vehicle's events. A vehicle may hold a third of all events, so
its history is cut into time-ordered parts. Each part is summarised as a function from any
state it may be entered with to the state it leaves; the per-vehicle fold then runs over one
row per part, and every part is replayed on its own from its true entry state.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from convoy.functions import policy as rules
from convoy.operators import scan
from convoy.session import cut
from convoy.settings import BreakerSettings, PolicySettings

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
STATE_CODES = {CLOSED: 0, HALF_OPEN: 1, OPEN: 2}

ORDER = ["event_time", "kind", "ref"]


class Breaker(NamedTuple):
    kind: str = CLOSED
    opened_us: int = 0
    successes: int = 0


class Step(NamedTuple):
    after: Breaker
    tripped: bool
    recovered: bool


def step(before: Breaker, at_us: int, trip: bool, cfg: BreakerSettings) -> Step:
    """One evaluation of the breaker at ``at_us`` (microseconds)."""
    state = before
    if state.kind == OPEN and at_us - state.opened_us >= cfg.cooldown_seconds * 1_000_000:
        state = Breaker(HALF_OPEN)
        if not cfg.probe_on_advance:
            return Step(state, False, False)
    if state.kind == OPEN:
        return Step(state, False, False)
    if trip:
        return Step(Breaker(OPEN, at_us, 0), True, False)
    if state.kind == CLOSED:
        return Step(state, False, False)
    successes = state.successes + 1
    if successes >= cfg.half_open_successes:
        return Step(Breaker(), False, True)
    return Step(Breaker(HALF_OPEN, 0, successes), False, False)


class Replay(NamedTuple):
    """What every event of a run of one vehicle does: state codes, opening times, transitions."""

    prior: np.ndarray
    after: np.ndarray
    opened_us: np.ndarray
    tripped: np.ndarray
    recovered: np.ndarray


def replay_run(
    state: Breaker, times: np.ndarray, trips: np.ndarray, cfg: BreakerSettings
) -> tuple[Replay, Breaker]:
    """Replay events in order, jumping from one change of state to the next.

    A closed breaker stays so up to the next trip, an open one up to the first event after its
    cooldown; the events in between are filled as slices.
    """
    n = len(times)
    out = Replay(*(np.full(n, STATE_CODES[CLOSED], np.int8) for _ in range(2)), np.zeros(n, np.int64),
                 np.zeros(n, bool), np.zeros(n, bool))
    trip_at = np.flatnonzero(trips)
    cooldown = int(cfg.cooldown_seconds * 1_000_000)
    i = 0
    while i < n:
        if state.kind == CLOSED:
            k = np.searchsorted(trip_at, i)
            j = int(trip_at[k]) if k < len(trip_at) else n
        elif state.kind == OPEN:
            j = i + int(np.searchsorted(times[i:], state.opened_us + cooldown))
            out.prior[i:j] = out.after[i:j] = STATE_CODES[OPEN]
            out.opened_us[i:j] = state.opened_us
        else:
            j = i
        if j < n:
            done = step(state, int(times[j]), bool(trips[j]), cfg)
            out.prior[j], out.after[j] = STATE_CODES[state.kind], STATE_CODES[done.after.kind]
            out.opened_us[j] = done.after.opened_us
            out.tripped[j], out.recovered[j] = done.tripped, done.recovered
            state = done.after
        i = j + 1
    return out, state


class Exit(NamedTuple):
    """How a part ends when entered in ``kind`` (open: with cooldown ending by ``upto_us``)."""

    kind: str
    upto_us: int
    successes: int
    to_kind: str
    to_opened_us: int
    to_successes: int


def summarise(times: list[int], trips: list[bool], cfg: BreakerSettings) -> list[Exit]:
    """All exits of a part, found backwards so that shared tails are computed once.

    An open breaker enters with a cooldown that ends at most one cooldown after the first
    event, so only events up to there can be its first probe.
    """
    n, need = len(times), cfg.half_open_successes
    cooldown = int(cfg.cooldown_seconds * 1_000_000)
    closed = [Breaker(CLOSED)] * (n + 1)
    half = [[Breaker(HALF_OPEN, 0, s)] * (n + 1) for s in range(need)]
    opened: list[Breaker] = [Breaker()] * n
    for i in range(n - 1, -1, -1):
        k = bisect.bisect_left(times, times[i] + cooldown, i + 1)
        if k == n:
            opened[i] = Breaker(OPEN, times[i])
        else:
            opened[i] = half[0][k if cfg.probe_on_advance else k + 1]
        closed[i] = opened[i] if trips[i] else closed[i + 1]
        for s in range(need):
            if trips[i]:
                half[s][i] = opened[i]
            else:
                half[s][i] = closed[i + 1] if s + 1 >= need else half[s + 1][i + 1]
    exits = [Exit(CLOSED, 0, 0, *closed[0])]
    exits += [Exit(HALF_OPEN, 0, s, *half[s][0]) for s in range(need)]
    last = bisect.bisect_left(times, times[0] + cooldown) if n else 0
    for i in range(min(last + 1, n)):
        probe = half[0][i if cfg.probe_on_advance else i + 1]
        if exits[-1].kind == OPEN and exits[-1][3:] == probe:
            exits.pop()  # Later probes that end alike are one exit.
        exits.append(Exit(OPEN, times[i], 0, *probe))
    return exits


def enter(state: Breaker, exits: Iterable[Exit], cfg: BreakerSettings) -> Breaker:
    """The state after a part that is entered in ``state``."""
    ends = state.opened_us + int(cfg.cooldown_seconds * 1_000_000)
    best: Exit | None = None
    for e in exits:
        if e.kind != state.kind:
            continue
        if state.kind == HALF_OPEN and e.successes != state.successes:
            continue
        if state.kind == OPEN:
            if e.upto_us < ends or (best is not None and best.upto_us <= e.upto_us):
                continue
        best = e
    if best is None:
        return state
    return Breaker(best.to_kind, best.to_opened_us, best.to_successes)


_EXITS = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField(scan.PART, T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("upto_us", T.LongType()),
        T.StructField("successes", T.IntegerType()),
        T.StructField("to_kind", T.StringType()),
        T.StructField("to_opened_us", T.LongType()),
        T.StructField("to_successes", T.IntegerType()),
    ]
)
_ENTRIES = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField(scan.PART, T.IntegerType()),
        T.StructField("in_kind", T.StringType()),
        T.StructField("in_opened_us", T.LongType()),
        T.StructField("in_successes", T.IntegerType()),
    ]
)


def correlated_events(
    quality: DataFrame, incidents: DataFrame, parts: int | None = None
) -> DataFrame:
    """QA batches and drift incidents of each vehicle in one order, tagged with parts.

    A drift incident takes the vehicle's latest rolling rate, batch count and streak (0 when
    there is none yet); a QA batch carries no drift.
    """
    batches = quality.select(
        "vehicle_id",
        F.col("window_end").alias("event_time"),
        F.lit(0).alias("kind"),
        F.lpad(F.col("window_no").cast("string"), 12, "0").alias("ref"),
        "rolling_rate",
        "batch_count",
        "streak",
        F.lit(0).cast("long").alias("drift_count"),
    )
    reports = incidents.select(
        rules.incident_vehicle(F.col("vehicle_id")).alias("vehicle_id"),
        "event_time",
        F.lit(1).alias("kind"),
        F.col("incident_id").alias("ref"),
        F.lit(None).cast("double").alias("rolling_rate"),
        F.lit(None).cast("long").alias("batch_count"),
        F.lit(None).cast("long").alias("streak"),
        rules.incident_drift_count(F.col("observed_value"), F.col("drifted_features")).alias(
            "drift_count"
        ),
    )
    tagged = scan.split_in_order(
        batches.unionByName(reports), ["vehicle_id"], ORDER, parts, settle=True
    )
    latest = {f"_{c}": F.col(c) for c in ("rolling_rate", "batch_count", "streak")}
    held = scan.running(tagged, ["vehicle_id"], ORDER, lasts=latest)
    return held.withColumns(
        {
            "rolling_rate": F.coalesce("_rolling_rate", F.lit(0.0)),
            "batch_count": F.coalesce("_batch_count", F.lit(0)),
            "streak": F.coalesce("_streak", F.lit(0)),
        }
    ).drop(*latest)


def _entry_states(decided: DataFrame, cfg: BreakerSettings) -> DataFrame:
    """Entry states of the parts of vehicles that span several parts.

    A part boundary splits at most one vehicle, so there are fewer such vehicles than parts,
    whatever the table's size, and both frames below are safe to broadcast.
    """
    spread = (
        decided.groupBy("vehicle_id")
        .agg(F.min(scan.PART).alias("_first"), F.max(scan.PART).alias("_last"))
        .where("_first < _last")
        .select("vehicle_id")
    )
    slim = decided.select(
        "vehicle_id", scan.PART, *ORDER, F.unix_micros("event_time").alias("at_us"), "trip"
    ).join(F.broadcast(spread), "vehicle_id", "left_semi")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        found = summarise(pdf["at_us"].tolist(), pdf["trip"].tolist(), cfg)
        out = pd.DataFrame(found, columns=Exit._fields)
        out.insert(0, "vehicle_id", pdf["vehicle_id"].iloc[0])
        out.insert(1, scan.PART, pdf[scan.PART].iloc[0])
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = Breaker(), []
        for part, group in pdf.sort_values(scan.PART).groupby(scan.PART, sort=True):
            rows.append((pdf["vehicle_id"].iloc[0], part, *state))
            listed = [Exit(*r) for r in group[list(Exit._fields)].itertuples(index=False)]
            state = enter(state, listed, cfg)
        return pd.DataFrame(rows, columns=_ENTRIES.names)

    summaries = slim.groupBy("vehicle_id", scan.PART).applyInPandas(exits, _EXITS)
    return summaries.groupBy("vehicle_id").applyInPandas(chain, _ENTRIES)


def timeline(decided: DataFrame, cfg: BreakerSettings = BreakerSettings()) -> DataFrame:
    """Replay the breaker over part-tagged decisions.

    Adds ``prior_state``, ``state``, ``opened_at``, ``tripped``, ``recovered``, ``trip_count``.
    The decisions and the replayed rows are read by several steps, so each is computed once
    and kept in the shared folder.
    """
    decided = cut(decided)
    states = F.broadcast(_entry_states(decided, cfg))
    entered = decided.join(states, ["vehicle_id", scan.PART], "left")
    added = [
        T.StructField("prior_state", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("opened_us", T.LongType()),
        T.StructField("tripped", T.BooleanType()),
        T.StructField("recovered", T.BooleanType()),
    ]
    names = pa.array([k for k, _ in sorted(STATE_CODES.items(), key=lambda x: x[1])])
    keep = decided.columns
    group = ["vehicle_id", scan.PART]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive sorted, so the state is carried from row to row and from batch to
        # batch; no vehicle's rows are gathered.
        current, state = None, Breaker()
        for rows in batches:
            times = rows["event_time"].cast(pa.timestamp("us", "UTC")).cast(pa.int64())
            if not len(rows):
                continue
            times = times.to_numpy()
            trips = rows["trip"].to_numpy(zero_copy_only=False).astype(bool)
            vehicles = rows["vehicle_id"].dictionary_encode().indices.to_numpy()
            parts = rows[scan.PART].to_numpy()
            new = np.flatnonzero((vehicles[1:] != vehicles[:-1]) | (parts[1:] != parts[:-1])) + 1
            runs = []
            for begin, end in zip([0, *new], [*new, len(rows)], strict=True):
                key = tuple(rows[c][int(begin)].as_py() for c in group)
                if key != current:
                    entry = [rows[c][int(begin)].as_py() for c in _ENTRIES.names[2:]]
                    current, state = key, Breaker() if entry[0] is None else Breaker(*entry)
                done, state = replay_run(state, times[begin:end], trips[begin:end], cfg)
                runs.append(done)
            prior, after, opened, tripped, recovered = (np.concatenate(x) for x in zip(*runs, strict=True))
            new_columns = [
                names.take(pa.array(prior)),
                names.take(pa.array(after)),
                pa.array(opened, mask=after != STATE_CODES[OPEN]),
                pa.array(tripped),
                pa.array(recovered),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(rows[c] for c in keep), *new_columns], [*keep, *(f.name for f in added)]
            )

    replayed = cut(
        entered.repartition(*group)
        .sortWithinPartitions(*group, *ORDER)
        .mapInArrow(replay, T.StructType([*decided.schema.fields, *added]))
    )
    counted = scan.running(
        replayed, ["vehicle_id"], ORDER, sums={"trip_count": F.col("tripped").cast("long")}
    )
    return counted.withColumn("opened_at", F.timestamp_micros("opened_us")).drop("opened_us")


def evaluate(
    quality: DataFrame,
    incidents: DataFrame,
    policy: PolicySettings = PolicySettings(),
    cfg: BreakerSettings = BreakerSettings(),
    parts: int | None = None,
) -> DataFrame:
    """From QA quality rows and drift incidents to the breaker timeline."""
    return timeline(rules.decide(correlated_events(quality, incidents, parts), policy), cfg)


def snapshot(
    states: DataFrame, as_of: Column, cfg: BreakerSettings = BreakerSettings()
) -> DataFrame:
    """The breaker of every vehicle at ``as_of``, from events up to then; the cooldown is applied
    at reading time."""
    picked = ["state", "opened_at", "trip_count", "event_time"]
    last = states.where(F.col("event_time") <= as_of).groupBy("vehicle_id").agg(
        F.max_by(F.struct(*picked), F.struct(*ORDER)).alias("_s")
    )
    cooled = F.unix_micros(as_of) - F.unix_micros("_s.opened_at") >= F.lit(
        int(cfg.cooldown_seconds * 1_000_000)
    )
    state = F.when((F.col("_s.state") == OPEN) & cooled, HALF_OPEN).otherwise(F.col("_s.state"))
    code = F.lit(None).cast("int")
    for name, value in STATE_CODES.items():
        code = F.when(F.col("state") == name, value).otherwise(code)
    return (
        last.withColumn("state", state)
        .withColumn("state_code", code)
        .select(
            "vehicle_id",
            "state",
            "state_code",
            F.col("_s.trip_count").alias("trip_count"),
            F.col("_s.event_time").alias("last_event"),
            F.col("_s.opened_at").alias("opened_at"),
        )
    )
