"""Chunking, vector upsert and exact nearest-neighbour search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from convoy.functions.coerce import strip
from convoy.functions.text import hash_embedding

# --- fixed values ----------------------------------------------------------------------
MAX_CHARS = 1200
MIN_K, MAX_K = 1, 10
# ---------------------------------------------------------------------------------------

# Vectors per side of one block of a search by cells.
QUERY_BLOCK, ITEM_BLOCK = 4_096, 65_536
# Bytes of vectors per side of one block of the search grid: what a task holds does not go by the table.
# Fewer queries than items, so that there are enough blocks for all tasks.
QUERY_BYTES, ITEM_BYTES = 4 << 20, 32 << 20
# Queries and items whose scores are one matrix; the first items, which set the bar, are fewer.
QUERY_ROWS, ITEM_ROWS, FIRST_ROWS = 256, 8_192, 1_024


def chunk_documents(docs: DataFrame, stem: str, text: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """Split texts before second-level headings, then into slices of ``max_chars``.

    Ids are ``stem-section-slice``; blank sections are skipped but keep their number.
    """
    sections = docs.select(
        F.col(stem).cast("string").alias("stem"),
        F.posexplode(F.split(text, r"\n(?=## )")).alias("section", "_raw"),
    ).withColumn("_part", strip(F.col("_raw")))
    starts = F.sequence(
        F.lit(0), F.floor((F.length("_part") - 1) / F.lit(max_chars)).cast("int")
    )
    return (
        sections.where(F.length("_part") > 0)
        .withColumn("slice", F.explode(starts))
        .select(
            F.concat_ws("-", "stem", "section", "slice").alias("chunk_id"),
            F.substr("_part", F.col("slice") * max_chars + 1, F.lit(max_chars)).alias("text"),
            F.col("stem").alias("source"),
            F.lit("runbook").alias("kind"),
            F.replace("stem", F.lit("-"), F.lit(" ")).alias("title"),
            "section",
            "slice",
        )
    )


def chunk_incidents(incidents: DataFrame) -> DataFrame:
    """One chunk per incident: its JSON text with sorted keys, and its metadata."""
    keys = sorted(incidents.columns)

    def shown(name: str) -> Column:
        held = F.col(name) if name in incidents.columns else F.lit(None)
        return F.coalesce(held.cast("string"), F.lit(""))

    reason = F.coalesce(F.nullif(shown("reason"), F.lit("")), shown("summary"))
    return incidents.select(
        F.concat(F.lit("inc-"), F.col("incident_id")).alias("chunk_id"),
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("text"),
        F.lit("incident").alias("kind"),
        shown("incident_id").alias("incident_id"),
        shown("vehicle_id").alias("vehicle_id"),
        shown("severity").alias("severity"),
        reason.alias("reason"),
    )


def embed(chunks: DataFrame, text: str = "text", vector: str = "vector") -> DataFrame:
    return chunks.withColumn(vector, hash_embedding(F.col(text)))


def upsert(existing: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Keep the last write of each key. A partial aggregate, so a key that is written over
    and over does not gather in one task."""
    point = F.sha2(F.col(key), 256).alias("point_id")
    both = existing.unionByName(changes)
    rest = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return newest.select(key, point, "_r.*")


def vectors(df: DataFrame) -> DataFrame:
    """(id, vector) with doubles, without rows that have no id, no vector, or one with null, NaN or infinite parts."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    typed = df.select("id", v.cast("array<double>").alias("vector"))
    return typed.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)


def dimension(items: DataFrame) -> int:
    """The length that most vectors have; the smaller one of two that are as frequent."""
    sizes = items.groupBy(F.size("vector").alias("n")).count()
    first = sizes.orderBy(F.desc("count"), "n").first()
    return first["n"] if first else 0


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(vectors), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def _best(q_m: np.ndarray, items: pa.Table, take: int) -> pa.Table:
    """The ``take`` nearest of the items for each query row; lower ids win among equals.

    Items are read in the order of their ids, so a later one counts only if its score is above the
    ``take``-th best so far: few scores pass that bar, and only those are rounded and sorted.
    """
    items = items.sort_by("id")
    i_ids, i_m = items["id"].combine_chunks(), _matrix(items["vector"].combine_chunks())
    take, found = min(take, len(items)), []
    cuts = [0, *range(max(FIRST_ROWS, take), len(items), ITEM_ROWS), len(items)]
    for at in range(0, len(q_m), QUERY_ROWS):
        asked = q_m[at : at + QUERY_ROWS]
        bar = np.full(len(asked), -np.inf)
        best_q, best_i, best = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        for low, high in zip(cuts, cuts[1:]):
            scores = asked @ i_m[low:high].T
            if not low:
                # Less than a unit of the rounding below, so that what is equal after it is not lost.
                bar = np.partition(scores, high - take, axis=1)[:, high - take] - 1.5e-12
            q, i = np.divmod(np.flatnonzero(scores > (bar + 4e-13)[:, None]), high - low)
            if not len(q):
                continue
            q, i = np.append(best_q, q), np.append(best_i, i + low)
            score = np.append(best, np.round(scores[q[len(best) :], i[len(best) :] - low], 12))
            order = np.lexsort((i, -score, q))
            q, i, score = q[order], i[order], score[order]
            # Every query has ``take`` or more: the first items gave as many.
            place = np.arange(len(q)) - np.searchsorted(q, q)
            best_q, best_i, best = (x[place < take] for x in (q, i, score))
            bar = best[take - 1 :: take]
        found.append(pa.table({"q": best_q + at, "item_id": i_ids.take(pa.array(best_i)), "score": best}))
    return pa.concat_tables(found)


def _named(found: pa.Table, q_ids: pa.Array) -> pa.Table:
    return pa.table(
        {
            "query_id": q_ids.take(found["q"].combine_chunks()),
            "item_id": found["item_id"],
            "score": found["score"],
        }
    )


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    exclude_self: bool = False,
    query_block: int | None = None,
    item_block: int | None = None,
) -> DataFrame:
    """Exact cosine top-k of every query over all items.

    Both sides have (id, vector); ``k`` is clamped to 1..10. Both are hashed into blocks, and each
    pair of blocks is one task that returns k rows per query; the best of all tasks are merged at
    the end. This is the exact search: its work is the product of both sides. Blocks hold as many
    vectors as ``QUERY_BYTES`` and ``ITEM_BYTES`` allow, unless their numbers are given.

    Rows without an id or a vector, with null or non-finite parts, or of another length than most items
    take no part on either side; a zero vector scores 0.
    """
    k = max(MIN_K, min(k, MAX_K))
    take = k + 1 if exclude_self else k
    q, i = vectors(queries), vectors(items)
    length = dimension(i)
    same = F.size("vector") == length
    query_block = query_block or max(1, QUERY_BYTES // (8 * max(1, length)))
    item_block = item_block or max(1, ITEM_BYTES // (8 * max(1, length)))
    q, i = q.where(same), i.where(same)
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["id"].dataType),
            T.StructField("item_id", i.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    near = _search_grid(q, i, take, schema, query_block, item_block)
    if exclude_self:
        near = near.where("query_id <> item_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_grid(
    q: DataFrame, i: DataFrame, take: int, schema: T.StructType, query_block: int, item_block: int
) -> DataFrame:
    """Blocks of queries against blocks of items, one pair of blocks per task."""
    n_q = max(1, math.ceil(q.count() / query_block))
    n_i = max(1, math.ceil(i.count() / item_block))

    def side(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        return df.withColumn(own, block).withColumn(other, every)

    pairs = ["q_block", "i_block"]
    left = side(q, "q_block", n_q, "i_block", n_i).groupBy(*pairs)
    right = side(i, "i_block", n_i, "q_block", n_q).groupBy(*pairs)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table(
                {
                    "query_id": asked["id"].slice(0, 0),
                    "item_id": held["id"].slice(0, 0),
                    "score": pa.array([], pa.float64()),
                }
            )
        vectors = _matrix(asked["vector"].combine_chunks())
        found = _best(vectors, held.select(["id", "vector"]), take)
        return _named(found, asked["id"].combine_chunks())

    return left.cogroup(right).applyInArrow(search, schema)


def retrieve(
    questions: DataFrame, chunks: DataFrame, k: int = 4, find: Callable[[DataFrame, DataFrame, int], DataFrame] = top_k
) -> DataFrame:
    """Search embedded chunks for each question; hits carry their text and score.

    ``find`` is the exact search, or ``cells.near`` for a share of the hits at a share of the work.
    """
    asked = questions.select("id", hash_embedding(F.col("text")).alias("vector"))
    held = chunks.select(F.col("chunk_id").alias("id"), "vector")
    hits = find(asked, held, k)
    return hits.join(chunks.drop("vector"), hits["item_id"] == chunks["chunk_id"]).drop("chunk_id")
