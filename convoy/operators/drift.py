"""Distribution drift: two-sample tests over whole tables and over sliding windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.functions.kstest import LIMITING, critical_statistic, exact_p_values, ks_p_value
from convoy.operators import scan
from convoy.settings import FEATURE_SCALE, FEATURES, DriftSettings

EMBEDDING = "embedding"
SCORED = (*FEATURES, EMBEDDING)

# Rows per block of the sliding analysis; each block also holds one window of earlier rows.
BLOCK = 20_000
# Windows whose counts are held at once.
CHUNK = 4_096


def z_score(name: str) -> Column:
    mean, std = FEATURE_SCALE[name]
    return (F.col(name) - F.lit(mean)) / F.lit(std if std > 1e-9 else 1.0)


def embedding_norm() -> Column:
    total = F.lit(0.0)
    for name in FEATURES:
        total = total + z_score(name) * z_score(name)
    return F.sqrt(total)


def long_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per record and scored feature, the embedding norm included."""
    values = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES]
    values.append(F.struct(F.lit(EMBEDDING).alias("feature"), embedding_norm().alias("value")))
    return df.select(*keep, F.inline(F.array(*values)))


def two_sample(
    df: DataFrame, keys: list[str], value: str, is_current: str, alpha: float = 0.05,
    method: str = LIMITING,
) -> DataFrame:
    """KS test per key between the current and the reference rows.

    ``method`` is how p-values are found: limiting suits whole tables, exact costs the product of
    both sample sizes per key.

    Equal values are counted first, both distribution functions are running sums over the
    ordered distinct values, and the statistic is the largest gap. No sample is collected.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count_if(is_current).alias("_a"), F.count_if(~F.col(is_current)).alias("_b"))
    )
    tagged = scan.split_in_order(counts, keys, [value], settle=True)
    upto = scan.running(
        tagged,
        keys,
        [value],
        sums={"_ca": F.col("_a"), "_cb": F.col("_b")},
        totals={"n_current": "_ca", "n_reference": "_cb"},
    )
    gap = F.abs(F.col("_ca") / F.col("n_current") - F.col("_cb") / F.col("n_reference"))
    tested = (
        upto.where("n_current > 0 and n_reference > 0")
        .groupBy(*keys, "n_current", "n_reference")
        .agg(F.max(gap).alias("ks_statistic"))
        .withColumn("p_value", ks_p_value(F.col("n_current"), F.col("n_reference"), F.col("ks_statistic"), method))
    )
    return tested.withColumns(
        {"drift_detected": F.col("p_value") < alpha, "drift_score": F.col("ks_statistic")}
    )


def column_drift(reference: DataFrame, current: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per monitored column, the score of the current table against the reference table."""
    both = (
        reference.select(*FEATURES)
        .withColumn("current", F.lit(False))
        .unionByName(current.select(*FEATURES).withColumn("current", F.lit(True)))
    )
    rows = long_features(both, ["current"]).where(F.col("feature") != EMBEDDING)
    return two_sample(rows, ["feature"], "value", "current", alpha)


def drifted_share(scores: DataFrame) -> DataFrame:
    """Share of columns that drifted, the fallback score when a column has none of its own."""
    return scores.agg(
        (F.count_if("drift_detected") / F.count(F.lit(1))).alias("share_of_drifted_columns")
    )


def centroid_metrics(
    window: DataFrame, baseline: DataFrame, drift: DriftSettings = DriftSettings()
) -> DataFrame:
    """Cosine similarity and distance between the mean vectors of two tables (one row)."""
    means = [F.avg(z_score(f)).alias(f) for f in FEATURES]
    a = window.agg(F.array(*means)).scalar()
    b = baseline.agg(F.array(*means)).scalar()
    both = window.sparkSession.range(1).select(a.alias("a"), b.alias("b"))
    dot, aa, bb, dd = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(len(FEATURES)):
        x, y = F.col("a")[i], F.col("b")[i]
        dot, aa, bb, dd = dot + x * y, aa + x * x, bb + y * y, dd + (x - y) * (x - y)
    norms = F.sqrt(aa) * F.sqrt(bb)
    cosine = F.coalesce(F.when(norms > 0, dot / norms), F.lit(1.0))
    distance = F.coalesce(F.sqrt(dd), F.lit(0.0))
    return both.select(
        cosine.alias("mean_cosine_similarity"), distance.alias("mean_euclidean_distance")
    ).withColumn(
        "drift_detected",
        (F.col("mean_cosine_similarity") < drift.cosine_floor)
        | (F.col("mean_euclidean_distance") > drift.euclidean_ceiling),
    )


def _embed(x: np.ndarray) -> np.ndarray:
    scale = np.array([FEATURE_SCALE[f] for f in FEATURES])
    return (x - scale[:, 0]) / scale[:, 1]


def _window_statistics(values: np.ndarray, reference: np.ndarray, size: int) -> np.ndarray:
    """KS statistic of each run of ``size`` values against the sorted reference.

    The reference's values cut the line into slots: each value, and what lies between two. Inside a slot
    the reference's distribution does not move, so the largest gap stands at a slot's end. A window's
    counts up to every slot are kept up by adding the value that enters and taking away the one that
    leaves, as differences of running counts; no window is sorted.
    """
    m = len(reference)
    points, counts = np.unique(reference, return_counts=True)
    # Slot 2i is below point i and above the one before, slot 2i + 1 the point itself.
    slot = np.searchsorted(points, values, "left") + np.searchsorted(points, values, "right")
    n_slots = 2 * len(points) + 1
    upto = np.repeat(np.append(0, np.cumsum(counts)), 2)[1:]
    out = np.empty(max(0, len(values) - size + 1))
    for at in range(0, len(out), CHUNK):
        mine = slot[at : at + CHUNK + size - 1]
        entered = np.zeros((len(mine) + 1, n_slots), np.int32)
        np.cumsum(mine[:, None] <= np.arange(n_slots), axis=0, out=entered[1:])
        held = entered[size:] - entered[: len(entered) - size]
        out[at : at + len(held)] = np.abs(held * m - upto * size).max(axis=1) / (m * size)
    return out


def result_fields(numeric_ids: bool) -> list[tuple[str, pa.DataType]]:
    """The columns of a scored window."""
    fields = [
        ("window_no", pa.int64()),
        ("window_end", pa.timestamp("us", "UTC")),
        ("last_event", pa.int64() if numeric_ids else pa.string()),
    ]
    for name in SCORED:
        fields += [(f"{name}_score", pa.float64()), (f"{name}_p", pa.float64())]
    fields += [
        ("drifted_features", pa.list_(pa.string())),
        ("drifted_count", pa.int64()),
        ("cosine_similarity", pa.float64()),
        ("euclidean_distance", pa.float64()),
        ("centroid_drift", pa.bool_()),
        ("breached", pa.bool_()),
        ("rising", pa.bool_()),
    ]
    return fields


def result_ddl(numeric_ids: bool) -> str:
    return ", ".join(f"{n} {_DDL[str(t)]}" for n, t in result_fields(numeric_ids))


def scorer(base: np.ndarray, numeric_ids: bool, drift: DriftSettings):
    """What scores a block of live rows (pos, event_time, event_id, features, _own) against ``base``."""
    size, stride, m = drift.window, drift.stride, drift.baseline
    z_base = _embed(base)
    references = [np.sort(base[:, i]) for i in range(len(FEATURES))]
    references.append(np.sort(np.linalg.norm(z_base, axis=1)))
    centroid = z_base.mean(0) if len(base) else np.zeros(len(FEATURES))
    steps = math.lcm(size, m)
    critical = round(critical_statistic(size, m, drift.alpha) * steps)

    empty = pa.schema(result_fields(numeric_ids)).empty_table()

    def score(block: pa.Table) -> pa.Table:
        rows = block.sort_by("pos")
        x = np.column_stack([rows[f].to_numpy() for f in FEATURES])
        z = _embed(x)
        if len(rows) < size or not len(references[0]):
            return empty
        series = [x[:, i] for i in range(x.shape[1])] + [np.linalg.norm(z, axis=1)]
        stats = np.column_stack(
            [_window_statistics(s, r, size) for s, r in zip(series, references)]
        )
        flags = np.rint(stats * steps) >= critical
        mean = sliding_window_view(z, size, axis=0).mean(axis=2)
        norms = np.linalg.norm(mean, axis=1) * np.linalg.norm(centroid)
        safe = np.where(norms > 0, norms, 1.0)
        cosine = np.where(norms > 0, mean @ centroid / safe, 1.0)
        distance = np.linalg.norm(mean - centroid, axis=1)
        breached = flags.sum(1) >= drift.min_features

        ends = rows.slice(size - 1)
        pos = ends["pos"].to_numpy()
        starts = pos - (size - 1)
        on_stride = starts % stride == 0
        earlier = np.zeros(len(starts), bool)
        if len(starts) > stride:
            earlier[stride:] = breached[:-stride]
        emit = np.flatnonzero(on_stride & ends["_own"].to_numpy(zero_copy_only=False))
        columns = {
            "window_no": starts[emit] // stride,
            "window_end": ends["event_time"].take(emit),
            "last_event": ends["event_id"].take(emit),
        }
        for i, name in enumerate(SCORED):
            columns[f"{name}_score"] = stats[emit, i]
            columns[f"{name}_p"] = exact_p_values(size, m, stats[emit, i])
        columns["drifted_features"] = [
            [n for n, hit in zip(SCORED, row) if hit] for row in flags[emit]
        ]
        columns["drifted_count"] = flags[emit].sum(1)
        columns["cosine_similarity"] = cosine[emit]
        columns["euclidean_distance"] = distance[emit]
        columns["centroid_drift"] = (cosine[emit] < drift.cosine_floor) | (
            distance[emit] > drift.euclidean_ceiling
        )
        columns["breached"] = breached[emit]
        columns["rising"] = (breached & ~earlier)[emit]
        return pa.table(columns).cast(empty.schema)

    return score


def windows(numbered: DataFrame, drift: DriftSettings = DriftSettings()) -> DataFrame:
    """Score every sliding window of live rows against the frozen baseline.

    ``numbered`` comes from ``drift_sequence``. The baseline is read once: it has
    ``drift.baseline`` rows (200) whatever the table's size. The live rows are cut into blocks
    that overlap by one window, so the shuffle moves each row about once, not once per window.
    One output row per window, at the row that closes it.
    """
    numeric_ids = not isinstance(numbered.schema["event_id"].dataType, T.StringType)
    frozen = numbered.where("phase = 'baseline'").select(*FEATURES).limit(drift.baseline).toArrow()
    base = np.column_stack([frozen[f].to_numpy() for f in FEATURES]) if len(frozen) else None
    if base is None or len(base) < drift.baseline:
        base = np.empty((0, len(FEATURES)))
    live = numbered.where("phase = 'live'").select("pos", "event_time", "event_id", *FEATURES)
    haloed, group = scan.with_halo(live, [], "pos", drift.window - 1 + drift.stride, BLOCK)
    return haloed.groupBy(*group).applyInArrow(scorer(base, numeric_ids, drift), result_ddl(numeric_ids))


_DDL = {
    "string": "string",
    "int64": "bigint",
    "double": "double",
    "bool": "boolean",
    "timestamp[us, tz=UTC]": "timestamp",
    "list<item: string>": "array<string>",
    "list<element: string>": "array<string>",
}


def score_map() -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in SCORED]), F.array(*[F.col(f"{n}_score") for n in SCORED])
    )


def incidents(scored: DataFrame, drift: DriftSettings = DriftSettings()) -> DataFrame:
    """One incident per rising edge of the breach condition."""
    key = F.concat(F.lit("drift"), F.lit("|"), F.col("window_no").cast("string"))
    return scored.where("rising").select(
        F.concat(F.lit("drift-"), F.substring(F.sha2(key, 256), 1, 12)).alias("incident_id"),
        F.lit("INCIDENT_SEVERITY_CRITICAL").alias("severity"),
        F.lit("drift-monitor").alias("source_service"),
        F.lit("drifted_feature_count").alias("metric_name"),
        F.lit(float(drift.min_features)).alias("threshold"),
        F.col("drifted_count").cast("double").alias("observed_value"),
        F.col("window_end").alias("event_time"),
        F.lit("INCIDENT_STATUS_OPEN").alias("status"),
        F.lit(None).cast("string").alias("vehicle_id"),
        "drifted_features",
        F.lit(drift.window).alias("window_size"),
        F.lit(drift.alpha).alias("alpha"),
    )


def signals(
    scored: DataFrame, chosen: Column, window_size: int = 50, count_flagged: bool = False
) -> DataFrame:
    """Drift signals of the chosen windows: scores, how many are above zero, and the largest.

    ``count_flagged`` counts the features that drifted instead of the scores above zero.
    """
    scores = F.map_values("feature_scores")
    above_zero = F.size(F.filter(scores, lambda v: v > 0.0))
    return scored.where(chosen).select(
        F.col("window_end").alias("generated_at"),
        F.concat(F.lit("data_drift_"), F.date_format("window_end", "yyyyMMdd'T'HHmmss'Z'")).alias(
            "source_report"
        ),
        F.lit(window_size).alias("window_size"),
        score_map().alias("feature_scores"),
        F.col("drifted_count").cast("int").alias("_flagged"),
    ).withColumns(
        {
            "drifted_feature_count": F.col("_flagged") if count_flagged else above_zero,
            "max_drift_score": F.array_max(scores),
        }
    ).drop("_flagged")
