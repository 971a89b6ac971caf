"""Exact deduplication by a stream with keyed state on disk.

Texts are equal when their normalised forms (each run of ASCII white space as one space) have the
same bytes. Rows pass through a stream whose state, in RocksDB and without expiry, holds for every
digest the stable identifier of the row that stays, the place of its content, and a count. A digest
seen more than once is a hit; hits are settled by comparing full texts, so that texts that share a
digest but differ stay apart.

Every step is a DataFrame operation: a group of copies is combined before each shuffle, and the
comparison of texts is an equi-join whose skewed side adaptive execution can split.

Defined cases. Null text counts as empty. A null ``doc_id`` is larger than any other. Rows that
repeat ``doc_id`` and text are copies of one another, and one of them stays. An empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm.common import scratch, stored, text_or_empty

SPACE = r"[\x20\x09-\x0D]"
# State on disk; files grow as they are written instead of being laid out in advance.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Each run of white space as one space; single spaces need no replacement."""
    return F.regexp_replace(text, rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _order(doc_id: Column, row: Column) -> Column:
    """Rows by ``doc_id``, null last, then by row number."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), row.alias("row"))


def first_seen(spark: SparkSession, rows: DataFrame, files_per_trigger: int = 64) -> DataFrame:
    """Stream ``rows`` (digest, doc_id, row, place) through keyed state.

    Returns digest, ``first`` (the least of the rows' order with its place) and ``size``. Every
    micro-batch writes the changed keys below its own id, so a batch that is run again after a loss
    replaces itself; the newest state of a key is the one with the largest count.
    """
    source, changes = scratch(spark, "digests"), scratch(spark, "digest-state")
    rows.write.parquet(source)
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        state = (
            spark.readStream.schema(rows.schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(source)
            .groupBy("digest")
            .agg(
                F.min(F.struct(_order(F.col("doc_id"), F.col("row")).alias("at"), F.col("place"))).alias("first"),
                F.count("*").alias("size"),
            )
        )
        schema = state.schema

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", scratch(spark, "digest-checkpoint"))
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    if query.lastProgress is None:
        return spark.createDataFrame([], schema)
    changed = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(changes)
    return changed.groupBy("digest").agg(F.max_by("first", "size").alias("first"), F.max("size").alias("size"))


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` may be any function of the normalised text; a weak one costs time, not correctness.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_column).alias("doc_id"), normalised(text_or_empty(text_column)).alias("text")
    ).withColumn("digest", digest(F.col("text")))
    rows = texts.select(
        "digest",
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("place"),
    )
    rows = stored(rows, "dedup-rows")
    state = stored(first_seen(spark, rows.drop("sha")), "dedup-state")

    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = rows.join(state.where("size = 1").select("digest"), "digest", "left_semi").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    # Full texts of hits only, each compared with the text of the row that the state names.
    hits = state.where("size > 1").select("digest", F.col("first.at.doc_id").alias("first_id"))
    members = stored(texts.join(hits, "digest"), "dedup-members")
    named = (
        members.where(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .dropDuplicates(["digest"])
        .select("digest", F.col("text").alias("first_text"))
    )
    # Written first, so that the join below is a plain one, whose hot digests the runtime splits.
    named = stored(named, "dedup-named")
    checked = members.join(named, "digest").select(
        "digest",
        "doc_id",
        F.when(F.col("text") != F.col("first_text"), F.col("text")).alias("other"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )
    checked = stored(checked, "dedup-hits")
    group = [F.col("digest"), F.col("other")]
    sizes = checked.groupBy(*group).agg(
        F.min(_order(F.col("doc_id"), F.col("row"))).alias("first"), F.count("*").alias("group_size")
    )
    sizes = stored(sizes, "dedup-sizes")
    copies = (
        checked.alias("c")
        .join(
            sizes.alias("s"),
            (F.col("c.digest") == F.col("s.digest")) & F.col("c.other").eqNullSafe(F.col("s.other")),
        )
        .select(
            "doc_id",
            F.col("first.doc_id").alias("keep_id"),
            "group_size",
            (F.col("c.row") == F.col("first.row")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    return alone.select(out).unionByName(copies.select(out))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    verdict = exact_dedup(docs, id_column, text_column)
    verdict = verdict.where("kept").groupBy("doc_id", "text_sha256").agg(F.max("group_size").alias("size"))
    # The row goes as one value, so none of its columns can clash with what is added here.
    keyed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"),
        F.col(id_column).alias("id"),
        F.sha2(normalised(text_or_empty(text_column)).cast("binary"), 256).alias("sha"),
    )
    same = F.col("d.id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.sha") == F.col("v.text_sha256"))
    kept = keyed.alias("d").join(verdict.alias("v"), same)
    # Only a row of a group can have a second row with its own id and text.
    alone = kept.where("size = 1").select("row.*")
    several = kept.where("size > 1").select("row", "id", "sha").dropDuplicates(["id", "sha"])
    return alone.unionByName(several.select("row.*"))
