"""A corpus pipeline: quality, exact copies, near copies, mixing, and token ids, in this order.

Every stage takes (spark, docs, sf_dir), returns a DataFrame, and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each stage's result as
Parquet to the shared folder and reads it again for the next, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convoy.llm import exact_dedup, jaccard_join, mixing, quality
from convoy.llm.common import stored, table
from convoy.llm.queries import bpe_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    values = stored(quality.with_statistics(docs), "text-statistics")
    return quality.accepted(docs, quality.learn(values, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one of smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of smallest id."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with the digests of the ids and of the bytes they decode to."""
    return bpe_digests(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

# The classifier's fit, verified Jaccard classes and merges by rank are beyond SQL; tests compare
# the stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
