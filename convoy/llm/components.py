"""Connected components of links between nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import discard, stored


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """Tie every node's neighbours (the larger ones, or the smaller ones) to the least of them.

    The least neighbours are written before they are joined back, so that the join reads two plain
    shuffles and the engine can split the links of a star's centre over many tasks.
    """
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m")), "least")
    joined = both.join(least, both["u"] == least["w"])
    if large:
        tied = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
    found = stored(tied.where("u != v").distinct(), "star")
    discard(least)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (u, v) with the least node that it is connected to.

    Rounds of large and small stars until no link changes; their number grows with the logarithm of
    the component's size. Each round is written to the shared folder, so none is ever run again.
    """
    now = stored(links.where("u != v").distinct(), "links")
    sign = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == sign:
            break
        sign, before = tuple(mark), now
        large = _starred(before, large=True)
        now = _starred(large, large=False)
        discard(before, large)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
