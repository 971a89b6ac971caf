"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A table of the index turns unit vectors by a fast pseudo-rotation (three rounds of random signs and
a Hadamard transform) and puts each into the cell of the signed axis that it is nearest to. A query
probes, in every table, the cells of the axes that it is nearest to itself; everything in them is a
candidate and is scored exactly, in double precision, on the original vectors.

Vectors are hashed and dealt to cells by Spark; cells meet their queries in blocks of at most about
``block`` vectors and ``block`` queries, so that a cell that holds a third of all rows becomes many
tasks. A block returns the best ``k`` of each of its queries and no other pairs.

Norms. Vectors are hashed by direction alone, and dealt to bands by norm, so that a long vector
changes nothing for the others. The ``k``-th best inner product found by the probes bounds from
below the cosine that a neighbour in a band must have. Where the probes reach that cosine with a
probability below ``recall``, or fewer than ``k`` were found, the query is compared with all of the
band. So every neighbour is reached with a probability of at least ``recall``, whatever the
dimension and the norms, up to how well turned axes stand for random ones.

Cost. Neighbours at an inner product around 0.37 in 64 dimensions are barely nearer than
chance; seven tables with 16 of 128 cells reach them with a probability of about 0.97, and look at
three fifths of the rows for it. Close neighbours are found by far fewer probes. ``tables`` and
``probes`` set the trade between probing and whole bands; the tests measure recall against brute force.

Defined cases. Rows take no part whose id or vector is null, whose vector is zero, empty, or holds a
null or a non-finite number. Vectors of different lengths count as filled up with zeros. Rows that
repeat an id count once, with the least of their vectors. Fewer than ``k`` candidates give fewer
rows; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.llm.common import in_arrow, stored

# Norms within a factor of the square root of two share a band; all shorter ones are in the last.
BANDS = 16
FOUND = "query_id long, vec_id long, score double"


def _signs(table: int, turn: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, turn]).choice(np.array([-1.0, 1.0], np.float32), dim)


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """``vectors`` (rows, a power of two wide) after three rounds of signs and Hadamard transform."""
    dim = vectors.shape[1]
    out = vectors
    for turn in range(3):
        out = out * _signs(table, turn, dim, seed)
        width = 1
        while width < dim:
            pairs = out.reshape(-1, dim // (2 * width), 2, width)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            out = out.reshape(-1, dim)
            width *= 2
        out = out / np.float32(np.sqrt(dim))
    return out


def nearest_axes(vectors: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """Cells of the ``probes`` nearest signed axes: i for the i-th axis, i + dim for its opposite."""
    turned = rotated(vectors, table, seed)
    both = np.concatenate([turned, -turned], axis=1)
    if probes == 1:
        return np.argmax(both, axis=1)[:, None].astype(np.int32)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes].astype(np.int32)


def reached(dim: int, tables: int, probes: int, recall: float, pairs: int = 2000) -> float:
    """The least cosine, in steps of 1/40, from which on a row is probed with a probability of ``recall``.

    Measured on random pairs of unit vectors: the cell of the one, and how many axes are nearer to the other.
    """
    if probes >= 2 * dim:
        return -1.0
    rng = np.random.default_rng([dim, pairs])
    one, other = rng.normal(size=(2, pairs, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    least = 1.0
    for cosine in np.arange(40, -1, -1) / 40:
        item = cosine * one + np.sqrt(1 - cosine * cosine) * other
        axis = np.abs(item).argmax(axis=1)[:, None]
        value = np.take_along_axis(one, axis, axis=1) * np.sign(np.take_along_axis(item, axis, axis=1))
        nearer = (one > value).sum(axis=1) + (-one > value).sum(axis=1)
        if 1 - (nearer >= probes).mean() ** tables < recall:
            break
        least = float(cosine)
    return least


def _usable(vector: Column) -> Column:
    """False for null, empty and zero vectors, and for components null, infinite or not a number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of a matrix, filled up with zeros to ``width``."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _hashed(rows: DataFrame, width: int, dim: int, top: float, tables: int, probes: int, seed: int) -> DataFrame:
    """id, vector (bytes), norm, band, and for each table the cell of the row and those that it would probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vectors = _matrix(batch.column("vector"), width)
                norms = np.sqrt((vectors * vectors).sum(axis=1))
                units = np.zeros((len(vectors), dim), np.float32)
                units[:, :width] = vectors / norms[:, None]
                bands = np.clip(np.floor(2 * np.log2(top / norms)), 0, BANDS - 1).astype(np.int32)
                own = [nearest_axes(units, t, 1, seed) for t in range(tables)]
                probed = [nearest_axes(units, t, probes, seed) for t in range(tables)]
                out = [batch.column("id")]
                out.append(pa.array([v.tobytes() for v in vectors], pa.binary()))
                out += [pa.array(norms), pa.array(bands)]
                for cells in (np.concatenate(own, axis=1), np.concatenate(probed, axis=1)):
                    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * cells.shape[1]
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel())))
                yield pa.RecordBatch.from_arrays(out, names=["id", "vector", "norm", "band", "cells", "probes"])

    return in_arrow(rows, run, "id long, vector binary, norm double, band int, cells array<int>, probes array<int>")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """For every row of ``scores`` the columns of the ``k`` largest, ties to the smaller id; ids ascend."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _scored(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asks: pa.Table, items: pa.Table) -> pa.Table:
        if not asks.num_rows or not items.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        items = items.sort_by("id")
        ids, query_ids = items.column("id").to_numpy(), asks.column("id").to_numpy()
        of = np.stack([np.frombuffer(v, np.float64) for v in items.column("vector").to_pylist()])
        out = []
        for at in range(0, len(query_ids), 256):
            own = query_ids[at : at + 256]
            wanted = np.stack([np.frombuffer(v, np.float64) for v in asks.column("vector")[at : at + 256].to_pylist()])
            # One sum per pair in one fixed order, so equal vectors have equal scores in every block.
            scores = np.einsum("ij,kj->ik", wanted, of)
            scores[own[:, None] == ids[None, :]] = -np.inf
            top = best(ids, scores, k)
            score = np.take_along_axis(scores, top, axis=1)
            some = score > -np.inf
            out.append((np.repeat(own, some.sum(axis=1)), ids[top][some], score[some]))
        query_id, vec_id, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score})

    return run


def _meet(items: DataFrame, asks: DataFrame, k: int, block: int) -> DataFrame:
    """The best of every block: ``items`` and ``asks`` have id, vector, tab and cell."""
    # At most tables x cells rows, or one for each band: a fixed number, whatever the size of the corpus.
    size = F.ceil(F.count("*") / block).cast("int")
    item_blocks = items.groupBy("tab", "cell").agg(size.alias("n_items"))
    ask_blocks = asks.groupBy("tab", "cell").agg(size.alias("n_asks"))
    blocks = F.broadcast(item_blocks.join(ask_blocks, ["tab", "cell"]))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        return df.join(blocks, ["tab", "cell"]).select(
            "id", "vector", "tab", "cell", mine.alias(own), every.alias(other)
        )

    keys = ["tab", "cell", "n_items", "n_asks"]
    left = dealt(asks, "n_asks", "n_items").groupBy(*keys)
    return left.cogroup(dealt(items, "n_items", "n_asks").groupBy(*keys)).applyInArrow(_scored(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.dropDuplicates(["query_id", "vec_id"])
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    tables: int = 7,
    probes: int = 16,
    block: int = 4096,
    seed: int = 9,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    recall: float = 0.9,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``queries`` holds.

    ``queries`` is a condition on the column ``id``. Every one of the ``k`` nearest is reached with a
    probability of at least ``recall``.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = (
        vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
        .where(F.col("id").isNotNull() & _usable(F.col("vector")))
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    width, high = rows.agg(F.max(F.size("vector")), F.max(norm)).first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = 1 << (width - 1).bit_length()
    probes = min(probes, 2 * dim)
    hashed = stored(_hashed(rows, width, dim, high, tables, probes, seed), "hashed-vectors")
    items = hashed.select("id", "vector", F.posexplode("cells").alias("tab", "cell"))
    # Read once more: a frame of its own, which the blocks can be joined with.
    asked = vectors.sparkSession.read.schema(hashed.schema).parquet(hashed._scratch).where(queries)
    asks = asked.select("id", "vector", F.posexplode("probes").alias("tab", "cell")).withColumn(
        "tab", F.floor(F.col("tab") / probes).cast("int")
    )
    found = stored(_ranked(_meet(items, asks, k, block), k), "neighbours")
    # A band in which a neighbour may stand at a cosine that the probes are not sure to reach is looked
    # at as a whole, as are all bands by queries that are short of k.
    worst = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    longest = F.lit(float(high)) * F.pow(F.lit(2.0), -F.col("cell") / 2)
    unsure = F.col("worst") < reached(dim, tables, probes, recall) * F.col("norm") * longest
    every_band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    whole = (
        asked.join(worst, asked["id"] == worst["query_id"], "left")
        .select("id", "vector", "norm", "worst", F.lit(0).alias("tab"), every_band.alias("cell"))
        .where(F.col("worst").isNull() | unsure)
        .select("id", "vector", "tab", "cell")
    )
    banded = hashed.select("id", "vector", F.lit(0).alias("tab"), F.col("band").alias("cell"))
    out = ["query_id", "vec_id", "score"]
    both = found.select(out).unionByName(_meet(banded, whole, k, block).select(out))
    return _ranked(both, k).select("query_id", "rank", "vec_id", "score")
