"""Ordered scans that never put one key's whole history into one task.

A window over ``partitionBy(key)`` sends all rows of a key to one task, and a fleet-wide
order would use a single task. Here the rows are split into ranges of (key, order), so a key that
holds a third of the table is spread over a third of the parts. Each part is scanned on its own,
one summary row per (key, part) is scanned across parts, and the two are combined. The summary has
at most (number of keys + number of parts) rows.

The ranges are cut at splitters from a bounded sample, and a row's part is a plain expression of
its own values: a search in one array of splitters. It is the same in every pass and on every executor, so nothing has to be written
down, and one shuffle by part serves both the scan of the parts and their summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from convoy.session import cut

PART = "_part"
# Rows sampled for each splitter, and at most for all of them together, which is what comes to the driver.
SAMPLED = 20
MOST_SAMPLED = 100_000
# Parts per shuffle partition: more of them even out what hashing parts to partitions makes uneven.
PARTS_PER_PARTITION = 2


def _comparable(df: DataFrame, name: str) -> Column:
    """The column in a form whose values come back from a sample unchanged."""
    kind = df.schema[name].dataType
    return F.unix_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name)


def _sampled(places: DataFrame, wanted: int) -> DataFrame:
    """About ``wanted`` rows of ``places``, or all if there are no more, chosen by hash.

    The share to take comes from a count, so no task sorts or sends more than it keeps.
    """
    known = places.count()
    if known <= wanted:
        return places
    # The hash's upper 53 bits as a number from 0 to 1.
    at = F.shiftrightunsigned(F.xxhash64("_at"), 11).cast("double") / float(1 << 53)
    return places.where(at < wanted / known)


def _at_or_below(value: Column, splitters: Column, count: int) -> Column:
    """How many of ``count`` ordered ``splitters`` are at or below ``value``: a binary search per row."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(count.bit_length()))])

    def step(passed: Column, size: Column) -> Column:
        reached = passed + size
        return F.when((reached <= count) & (F.get(splitters, reached - 1) <= value), reached).otherwise(passed)

    return F.aggregate(steps, F.lit(0), step)


def _part(at: Column, kind: T.StructType, splitters: list[str]) -> Column:
    """The part of a row at ``at``, given the splitters as JSON objects in order."""
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])
    # One literal once the plan is optimised, whatever the number of parts.
    known = F.from_json(F.lit(f"[{','.join(splitters)}]"), T.ArrayType(kind))
    # As the element of an array the place is worked out once, not at every step of the search.
    return F.transform(F.array(at.cast(kind)), lambda v: _at_or_below(v, known, len(splitters)))[0]


def split_in_order(
    df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, settle: bool = False
) -> DataFrame:
    """Tag each row with its part, a range of (keys, order), and bring parts together.

    ``order`` must be unique within a key. The sample is chosen by hash, so it is the same
    whenever the rows are. Counting and drawing it read the input before the split does; ``settle``
    writes an input that is costly to make, and narrow, to the shared folder first.
    """
    if settle:
        df = cut(df)
    by = [*keys, *order]
    if parts is None:
        parts = PARTS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(*[_comparable(df, c).alias(c) for c in by])
    sample = _sampled(df.select(at.alias("_at")), min(SAMPLED * parts, MOST_SAMPLED))
    rows = sample.orderBy("_at").select(F.to_json("_at", {"ignoreNullFields": "false"})).collect()
    chosen = list(dict.fromkeys(rows[i * len(rows) // parts][0] for i in range(1, parts))) if rows else []
    if not chosen:
        return df.withColumn(PART, F.lit(0)).repartition(PART)
    return df.withColumn(PART, _part(at, sample.schema["_at"].dataType, chosen)).repartition(PART)


def _within(keys: list[str], order: list[str]) -> WindowSpec:
    return (
        Window.partitionBy(*keys, PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _whole(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _before(keys: list[str]) -> WindowSpec:
    return _whole(keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums, running maxima and last-non-null values to a part-tagged frame.

    ``df`` carries the ``_part`` column, increasing with ``order`` within each key. Keys must
    not be null. ``totals`` adds, under a new name, what a running sum reaches at the key's
    end; it comes from the summary, so no join on the bare key is needed.
    """
    sums, maxima, lasts, totals = sums or {}, maxima or {}, lasts or {}, totals or {}
    within, before = _within(keys, order), _before(keys)
    values = {f"_v_{name}": col for name, col in {**sums, **maxima, **lasts}.items()}
    base = df.withColumns(values)

    summary = (
        [F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums]
        + [F.max(f"_v_{c}").alias(f"_t_{c}") for c in maxima]
        + [
            F.max_by(f"_v_{c}", F.when(F.col(f"_v_{c}").isNotNull(), F.struct(*order))).alias(
                f"_t_{c}"
            )
            for c in lasts
        ]
    )
    carried = (
        [F.sum(f"_t_{c}").over(before).alias(f"_c_{c}") for c in sums]
        + [F.max(f"_t_{c}").over(before).alias(f"_c_{c}") for c in maxima]
        + [F.last(f"_t_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in lasts]
        + [F.sum(f"_t_{c}").over(_whole(keys)).alias(name) for name, c in totals.items()]
    )
    # The summary asks for all columns, so that it reads the very shuffle that the scan reads.
    same = F.max(F.xxhash64(*df.columns)).alias("_same")
    carry = (
        base.groupBy(*keys, PART)
        .agg(*summary, same)
        .where(F.col("_same").isNotNull())
        .select(*keys, PART, *carried)
    )

    local = {f"_l_{c}": F.sum(f"_v_{c}").over(within) for c in sums}
    local |= {f"_l_{c}": F.max(f"_v_{c}").over(within) for c in maxima}
    local |= {f"_l_{c}": F.last(f"_v_{c}", ignorenulls=True).over(within) for c in lasts}
    joined = base.withColumns(local).join(carry, [*keys, PART])

    out = {c: F.coalesce(f"_c_{c}", F.lit(0)) + F.coalesce(f"_l_{c}", F.lit(0)) for c in sums}
    out |= {c: F.greatest(f"_c_{c}", f"_l_{c}") for c in maxima}
    out |= {c: F.coalesce(f"_l_{c}", f"_c_{c}") for c in lasts}
    return joined.select(*df.columns, *[col.alias(c) for c, col in out.items()], *totals)


def keyed_sequence(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "seq",
    parts: int | None = None,
    settle: bool = False,
) -> DataFrame:
    """Dense 0-based row number per key (fleet-wide when ``keys`` is empty); ``settle`` as in ``split_in_order``."""
    tagged = split_in_order(df, keys, order, parts, settle)
    numbered = running(tagged, keys, order, sums={name: F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col(name) - 1).drop(PART)


def with_halo(
    df: DataFrame, keys: list[str], seq: str, reach: int, block: int
) -> tuple[DataFrame, list[str]]:
    """Cut a dense sequence into blocks, each also holding the ``reach`` rows before it.

    Copies carry ``_own = false``. Windows of up to ``reach`` preceding rows can then be taken
    inside a block; returns the frame and the grouping columns.
    """
    home = F.expr(f"{seq} div {block}")
    near_end = (F.col(seq) % F.lit(block)) >= F.lit(max(block - reach, 0))
    out = (
        df.withColumn("_home", home)
        .withColumn(
            "_block",
            F.explode(
                F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
                    F.array("_home")
                )
            ),
        )
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )
    return out, [*keys, "_block"]


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key, without holding a key's values in one task.

    Equal values are counted first; the ranks come from a running sum over the ordered
    distinct values, and only the rows on either side of each wanted rank are kept.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    tagged = split_in_order(counts, keys, [value], settle=True)
    ranked = running(tagged, keys, [value], sums={"_upto": F.col("_n")}, totals={"_size": "_upto"})
    first, after = F.col("_upto") - F.col("_n"), F.col("_upto")

    def near(p: Column) -> Column:
        rank = p * (F.col("_size") - 1)
        return (F.floor(rank) < after) & (F.ceil(rank) >= first)

    wanted = None
    for p in probs.values():
        wanted = near(F.lit(p)) if wanted is None else wanted | near(F.lit(p))
    # Only the few values beside a wanted rank are laid out by probability.
    spots = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in probs.items()])
    at = ranked.where(wanted).withColumn("_spot", F.explode(spots)).withColumn(
        "_rank", F.col("_spot.p") * (F.col("_size") - 1)
    )
    lower, upper = F.floor("_rank"), F.ceil("_rank")
    has_lower = (lower >= first) & (lower < after)
    has_upper = (upper >= first) & (upper < after)
    picked = at.where(has_lower | has_upper).groupBy(*keys, F.col("_spot.name").alias("_name")).agg(
        F.max(F.when(has_lower, F.col(value))).alias("_lo"),
        F.max(F.when(has_upper, F.col(value))).alias("_hi"),
        F.max(F.col("_rank") - lower).alias("_f"),
    )
    result = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, result)).alias(n) for n in probs]
    )
