import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from convoy.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t).cast("string").cast("binary")])
def test_odd_rows(odd, digest):
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()
    assert sorted(map(tuple, got), key=repr) == expected([(r.doc_id, r.text) for r in odd.collect()])


def test_several_batches_and_no_rows(spark, docs, none):
    rows = docs.repartition(7).select(
        exact_dedup.sha256(F.col("text")).alias("digest"),
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.lit("").alias("place"),
    )
    state = exact_dedup.first_seen(spark, rows, files_per_trigger=2).collect()
    want = {r.text: r.n for r in docs.groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert sorted(r["size"] for r in state) == sorted(want.values())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_kept_rows(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    want = [r for r in expected([(r.doc_id, r.text) for r in odd.collect()]) if r[3]]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r[0]) for r in want)
