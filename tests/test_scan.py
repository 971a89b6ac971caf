import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.operators import scan


def hot_rows(spark, n=900):
    """A third of the rows share one key and, for a while, one instant."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        at = 500 if 300 < i < 600 else i
        rows.append((key, at, i, rng.randrange(5), i % 7 == 0))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at long, id long, v long, flag boolean")


def test_sequence_matches_a_window_when_the_hot_key_spans_parts(spark):
    df = hot_rows(spark)
    tagged = scan.split_in_order(df, ["k"], ["at", "id"], parts=7)
    assert tagged.where("k = 'hot'").select(scan.PART).distinct().count() > 1
    sizes = [r["count"] for r in tagged.groupBy(scan.PART).count().collect()]
    assert max(sizes) < 300
    got = scan.keyed_sequence(df, ["k"], ["at", "id"], parts=7)
    want = F.row_number().over(Window.partitionBy("k").orderBy("at", "id")) - 1
    assert got.withColumn("w", want).where("seq <> w").count() == 0
    assert got.count() == 900


def test_plan_and_sample_do_not_grow_with_the_parts(spark, monkeypatch):
    df = hot_rows(spark)

    def nodes(parts):
        plan = scan.split_in_order(df, ["k"], ["at", "id"], parts=parts)._jdf.queryExecution().optimizedPlan()
        return [plan.apply(i).expressions().toString().count("CASE") for i in range(2)]

    assert nodes(4) == nodes(400)
    places = df.select(F.struct("k", "at", "id").alias("_at"))
    assert 50 < scan._sampled(places, 100).count() < 200
    assert scan._sampled(places, 5000).count() == 900
    monkeypatch.setattr(scan, "MOST_SAMPLED", 50)
    tagged = scan.split_in_order(df, ["k"], ["at", "id"], parts=20)
    assert tagged.select(scan.PART).distinct().count() == 20


def test_parts_keep_the_order_of_odd_values(spark):
    rows = [(None, 1.5, 1), ('a"é\n', float("nan"), 2), ("", float("inf"), 3), ("b", -0.1, 4), ("b", None, 5)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    tagged = scan.split_in_order(df, ["k"], ["v", "id"], parts=5)
    want = [r.id for r in df.orderBy("k", "v", "id").collect()]
    assert [r.id for r in tagged.orderBy(scan.PART).collect()] == want
    assert scan.split_in_order(df.where("false"), ["k"], ["v", "id"], parts=5).count() == 0


def test_sequence_without_keys_is_dense(spark):
    got = scan.keyed_sequence(hot_rows(spark), [], ["at", "id"], parts=5).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(900))
    assert [(r["at"], r.id) for r in got] == sorted((r["at"], r.id) for r in got)


def test_running_sum_max_last_and_totals(spark):
    df = hot_rows(spark)
    tagged = scan.split_in_order(df, ["k"], ["at", "id"], parts=6)
    flagged = F.when(F.col("flag"), F.col("id"))
    got = scan.running(
        tagged,
        ["k"],
        ["at", "id"],
        sums={"s": F.col("v")},
        maxima={"m": F.col("v")},
        lasts={"l": flagged},
        totals={"all": "s"},
    )
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("k")
    checked = got.withColumns(
        {
            "ws": F.sum("v").over(w),
            "wm": F.max("v").over(w),
            "wl": F.last(flagged, ignorenulls=True).over(w),
            "wa": F.sum("v").over(whole),
        }
    )
    assert checked.where("s <> ws or m <> wm or not (l <=> wl) or all <> wa").count() == 0


def test_halo_blocks_see_the_rows_before_them(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("seq"))
    out, group = scan.with_halo(df, ["k"], "seq", reach=4, block=16)
    w = Window.partitionBy(*group).orderBy("seq").rowsBetween(-4, 0)
    got = out.withColumn("s", F.sum("seq").over(w)).where("_own")
    assert got.count() == 1000
    want = Window.partitionBy("k").orderBy("seq").rowsBetween(-4, 0)
    assert got.withColumn("w", F.sum("seq").over(want)).where("s <> w").count() == 0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.integers(0, 9, 400).astype(float), "b": rng.normal(0, 1, 201), "c": [4.0]}
    rows = [(k, float(v)) for k, values in data.items() for v in values]
    df = spark.createDataFrame(rows + [("a", None)], "k string, v double")
    probs = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    for r in scan.exact_quantiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert abs(r[name] - np.percentile(data[r.k], p * 100)) < 1e-9
