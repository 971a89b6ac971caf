"""The pipeline's stages against brute-force versions, each on what its predecessor kept."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from convoy.llm import mixing, quality
from convoy.llm.common import stored
from convoy.llm.queries import vocabulary
from tests.llm.test_jaccard_join import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, [r.asDict() for r in docs.collect()]
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), f"test-stage-{number}")
        rows = [r.asDict() for r in docs.collect()]
        if number < 4:
            assert docs.columns == columns, name
        kept[number] = (before, rows)
        before = rows

    every, good = kept[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    source = spark.read.parquet(f"{sf}/documents.parquet")
    values = quality.with_statistics(source)
    score = {r.doc_id: r.score for r in quality.scored(values, quality.learn(values, labels)).collect()}
    assert {r["doc_id"] for r in good} == {i for i, s in score.items() if s >= 0.7}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r["doc_id"] in {g["doc_id"] for g in good} for r in every if truth.get(r["doc_id"]) == 1)

    given, single = kept[1]
    groups = defaultdict(list)
    for r in given:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in single) == sorted(min(g) for g in groups.values())

    given, apart = kept[2]
    classes = brute({r["doc_id"]: r["text"] for r in given})
    assert {r["doc_id"] for r in apart} == {i for i, (root, _, _) in classes.items() if root == i}

    given, mixed = kept[3]
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in given}
    size = {r["doc_id"]: len(r["text"].split()) for r in given}
    total = sum(size.values())
    assert abs(sum(n * size[i] for i, n in times.items()) - 1.5 * total) < 0.1 * total

    given, tokens = kept[4]
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary().ranks, special_tokens={}
    )
    text = {r["doc_id"]: r["text"] for r in given}
    assert Counter(r["doc_id"] for r in tokens) == times
    for r in tokens:
        assert r["ids"] == known.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_no_documents(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_null_and_repeated_ids(spark, sf):
    """Rows that share an id are kept and drawn one by one, whatever their source."""
    said = [f"{i} " + " ".join(f"w{i}x{j}" for j in range(5 + i % 40)) for i in range(120)]
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else i, said[i], "abc"[i % 4 % 3], i) for i in range(120)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string, place long"), "odd-ids")
    mixed = mixing.mix(docs).collect()
    got = corpus_pipeline.mix_sources(spark, docs, sf)
    assert got.columns == docs.columns
    times = Counter(r.place for r in got.collect())
    # Which of two rows equal in id, source and size is drawn is open; how many are is not.
    own, want = Counter(), Counter()
    for doc_id, text, source, place in rows:
        own[doc_id, source, len(text.split()), times[place]] += 1
    for r in mixed:
        want[r.doc_id, r.source, r.size, r.repeats] += 1
    assert own == want
    for source in "abc":
        taken = sum(times[place] * len(text.split()) for _, text, of, place in rows if of == source)
        target = next(r.target for r in mixed if r.source == source)
        assert abs(taken - target) <= 45

    near = " ".join(f"n{j}" for j in range(80))
    rows = [(1, near, 0), (1, near, 1), (2, near + " end", 2), (None, said[50], 3), (None, said[50], 4), (1, said[60], 5),
            (3, "short", 6), (3, "short", 7), (None, said[70], 8)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, place long"), "odd-ids")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted(
        [(1, near), (0, said[50]), (1, said[60]), (3, "short"), (0, said[70])]
    )


def test_stages_keep_columns_of_any_name(spark):
    """Input columns named as what the stages work with come through unchanged."""
    from pyspark.sql import functions as F

    from convoy.llm import exact_dedup, jaccard_join, mixing, quality

    rows = [(i, f"some words of text {i // 2} that make up a sentence, and then another one. " * 3, "a") for i in range(8)]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string")
    names = "_sha _hash _id _alt _rows _size _stat_upper id hash sha size rows row verdict log_chars upper draw tie edge last whole digest".split()
    wide = docs.withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    rules = quality.Rules([(((0, False, -1.0),), 5.0)], 0.0)
    for stage in (exact_dedup.keep_first, jaccard_join.keep_one, mixing.mixed, lambda d: quality.accepted(d, rules)):
        kept = stage(wide)
        assert kept.columns == wide.columns
        for r in kept.collect():
            assert all(r[n] == f"{n}-{'' if r.doc_id is None else r.doc_id}" for n in names)
