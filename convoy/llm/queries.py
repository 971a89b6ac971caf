"""The registered query of every operator, over its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    license_scan,
    mixing,
    neighbours,
    periodic_runs,
    prefix_trie,
    quality,
    substring_dedup,
    suffix_dedup,
)
from convoy.llm.common import stored, table

RANKS = "byte_bpe_50k.tiktoken"


@functools.cache
def vocabulary(name: str = RANKS) -> bpe.Vocabulary:
    return bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``docs`` encoded and decoded: ids and bytes, with their number and digests."""
    words = vocabulary()
    return (
        bpe.encode_decode(docs, words)
        .withColumn("n_tokens", F.size("ids").cast("long"))
        .withColumn("ids_sha256", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256))
        .withColumn("decoded_sha256", F.sha2("decoded", 256))
    )


def _removed() -> Column:
    return F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("n_tokens").alias("n_bytes"),
        _removed().alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("n_tokens").alias("n_words"),
        _removed().alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("removed").cast("long").alias("n_spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base, own = F.col("places.label"), F.col("matches.label")

    def joined(labels: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))

    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"),
        F.array_max("places.at").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max("matches.score"), F.lit(0.0)).alias("score"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = stored(quality.with_statistics(table(spark, sf_dir, "documents")), "text-statistics")
    return quality.scored(values, quality.learn(values, table(spark, sf_dir, "labels")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "rep_id", "n_links")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"]))
    )
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs.collapse(docs).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(
        table(spark, sf_dir, "conversations"),
        base=lambda c: c - c % 100,
        heads=lambda c: F.crc32(c.cast("string").cast("binary")) % 6,
        most_heads=5,
    ).drop("x", "y")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_html_text": op3_html_text,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_neighbours": op9_neighbours,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_decontaminate": op12_decontaminate,
    "op13_prefix_trie": op13_prefix_trie,
}
