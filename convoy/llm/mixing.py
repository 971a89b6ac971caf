"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix in proportion to its weight, but no more than ``epochs`` times
its own size; what a source cannot take is shared again among the others by weight, until no share
is above its cap. The level at which that stops is found in closed form over the table of sources,
ordered by cap per weight.

A source's target is then met by whole and fractional repetitions: every document is repeated
``floor(target / size of the source)`` times, and documents drawn in a seeded order are repeated
once more until their words fill the rest. The order is the MD5 of seed and ``doc_id``, then a hash
of the row. Its leading hexadecimal digits cut a source into 4,096 bins whose totals are summed
before any shuffle; in the one bin in which the rest runs out, hashes and sizes alone are ordered to
find the last document that is taken. That leaves one row per source, and documents are compared
with it where they are: they are never moved, and a source that holds a third of them is not sorted.

Defined cases. Null text has size 0. A null source is a source of its own, after all others. Rows
without an id are drawn by the hash of the row; rows that repeat ``doc_id`` one by one, and rows
that agree in id, source and text as one, together taken or not. Documents of size 0 take nothing;
if all have size 0, all targets are 0. An empty table gives no rows. Columns of the input other
than the three named are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.llm.common import stored, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
BIN_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, share: float, epochs: float, weights: Sequence[float]) -> DataFrame:
    """Add ``target`` to ``sources`` (source, source_size): one row per source.

    With caps c and weights w ordered by c / w, the sources at their cap are a prefix: source i is
    in it if level i, what is left to share per weight once all before it are capped, is at least
    c / w. Levels fall after the first source that is not, so that one's level is the largest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before"))
    return (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("open_level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("ratio") > F.col("level"), F.col("open_level") * F.col("weight")).otherwise(F.col("cap")),
        )
        .select("source", "source_size", "target")
    )


def _keys(seed: str, id_column: str, text_column: str, source_column: str) -> dict[str, Column]:
    """Where a document stands in its source's order: source, draw, tie, and the bin of the draw."""
    doc_id = F.col(id_column).cast("string")
    tie = F.xxhash64(doc_id, text_or_empty(text_column), F.col(source_column).cast("string"))
    named = F.coalesce(doc_id, F.concat(F.lit("null:"), tie.cast("string")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary"))
    return {"source": F.col(source_column).cast("string"), "draw": draw, "tie": tie}


def _sized(docs: DataFrame, id_column: str, text_column: str, keys: dict[str, Column]) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"),
        n_words(text_or_empty(text_column)).alias("size"),
        *[c.alias(n) for n, c in keys.items()],
    )


def _plan(sized: DataFrame, share: float, epochs: float, weights: Sequence[float]) -> DataFrame:
    """One row per source: source_size, target, whole, the bin where the rest runs out (``edge``), and the
    last document of that bin that is taken (``last``)."""
    sized = sized.withColumn("bin", F.substring("draw", 1, BIN_DIGITS))
    bins = stored(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), share, epochs, weights)
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    sources = sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")
    placed = bins.withColumn("before", before).alias("b").join(sources.alias("s"), _same("b", "s"))
    beyond = F.col("before") + F.col("bin_size") > F.col("rest")
    ends = stored(
        placed.groupBy("s.source", "source_size", "target", "whole", "rest").agg(
            F.min(F.when(beyond, F.col("bin"))).alias("edge"), F.min(F.when(beyond, F.col("before"))).alias("before")
        ),
        "mix-edges",
    )
    # Only hashes and sizes of the bins in which the rests run out are put in order.
    in_edge = (
        sized.alias("d")
        .join(ends.alias("e"), _same("d", "e") & (F.col("d.bin") == F.col("e.edge")))
        .groupBy("e.source", "rest", "before", "draw", "tie")
        .agg(F.sum("size").alias("size"))
    )
    so_far = Window.partitionBy("source").orderBy("draw", "tie").rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.col("before") + F.coalesce(F.sum("size").over(so_far), F.lit(0))
    last = (
        in_edge.where(F.col("before") <= F.col("rest"))
        .withColumn("drawn", drawn)
        # The document that crosses the rest is taken if that ends nearer.
        .where(F.col("drawn") + F.col("size") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("draw", "tie")).alias("last"))
    )
    plan = ends.alias("e").join(last.alias("l"), _same("e", "l"), "left")
    return stored(plan.select("e.source", "source_size", "target", "whole", "edge", "last"), "mix-plan")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _repeats() -> Column:
    """How often a document ``d`` stands in the mix by its source's plan ``p``."""
    edge, last = F.col("p.edge"), F.col("p.last")
    early = F.substring("d.draw", 1, BIN_DIGITS) < edge
    taken = early | F.coalesce(F.struct("d.draw", "d.tie") <= last, F.lit(False))
    return F.col("p.whole") + F.when(edge.isNull(), 1).when(taken, 1).otherwise(0)


def mix(
    docs: DataFrame,
    share: float = 1.5,
    epochs: float = 2.0,
    weights: Sequence[float] = WEIGHTS,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken.

    ``repeats`` is how often the document stands in the mix, never above ``epochs`` rounded up.
    """
    sized = stored(_sized(docs, id_column, text_column, _keys(seed, id_column, text_column, source_column)), "mix-sizes")
    plan = _plan(sized, share, epochs, weights)
    placed = sized.alias("d").join(plan.alias("p"), _same("d", "p"))
    both = placed.select("doc_id", "d.source", "size", "source_size", "target", _repeats().alias("repeats"))
    return both.withColumn("taken", F.col("repeats") * F.col("size"))


def mixed(
    docs: DataFrame,
    share: float = 1.5,
    epochs: float = 2.0,
    weights: Sequence[float] = WEIGHTS,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it.

    A row's repeats are worked out on the row itself and never looked up by its id, which other
    rows may share. ``docs`` must read the same each time, as a written table does.
    """
    keys = _keys(seed, id_column, text_column, source_column)
    plan = _plan(stored(_sized(docs, id_column, text_column, keys), "mix-sizes"), share, epochs, weights)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    placed = docs.select(row, *[c.alias(n) for n, c in keys.items()]).alias("d").join(plan.alias("p"), _same("d", "p"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    taken = placed.select("row", _repeats().alias("repeats")).where("repeats > 0")
    return taken.select("row", copies.alias("copy")).select("row.*")
