import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import quality
from convoy.llm.queries import op6_quality


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    for value in np.unique(scores):
        ranks[scores == value] = ranks[scores == value].mean()
    ones = labels == 1
    return (ranks[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op6_quality(spark, sf).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    truth = np.array([labels[r.doc_id] for r in tested])
    assert auc(np.array([r.score for r in tested]), truth) > 0.97
    assert np.mean([r.predicted == t for r, t in zip(tested, truth, strict=True)]) > 0.95


def test_statistics(spark):
    text = "Ab, c1 ab\n*** ab.  É!"
    row = spark.createDataFrame([(text,)], "t string").select(
        *[c.alias(n) for n, c in quality.statistics(F.col("t")).items()]
    ).first().asDict()
    words = text.split()
    assert list(row) == quality.NAMES
    assert row["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert row["upper"] == pytest.approx(2 / len(text))
    assert row["marks"] == pytest.approx(len(re.findall(r"[*!]", text)) / len(text))
    assert row["bare_words"] == pytest.approx(1 / len(words))
    assert row["stops"] == pytest.approx(2 / len(words))


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, len(quality.NAMES)))
    y = ((x[:, 1] > 0.4) & (x[:, 3] <= 0.6)).astype(float)
    rules = quality.fit_rules(x[:1500], y[:1500])
    assert np.mean((rules.score(x[1500:]) > 0.5) == y[1500:]) > 0.95
    every = quality.tree_rules(x[:1500], y[:1500], quality.TREES, quality.DEPTH, 6)
    assert 0 < len(rules.rules) < len(every)


def test_lasso_against_its_conditions():
    """At the optimum no gradient exceeds the penalty, and at weights other than 0 it equals it."""
    rng = np.random.default_rng(1)
    x = (rng.uniform(size=(800, 12)) < 0.4).astype(float)
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    weight, bias = quality.lasso_logistic(x, y, 0.01, 3000)
    mean = x.mean(axis=0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    gradient = ((x - mean) / spread).T @ (1 / (1 + np.exp(-(x @ weight + bias))) - y) / len(y)
    assert (np.abs(gradient) <= 0.01 + 1e-4).all()
    assert np.allclose(gradient[weight != 0], -0.01 * np.sign(weight[weight != 0]), atol=1e-4)


def test_compiled_expression_scores_as_the_rules(spark, docs):
    values = quality.with_statistics(docs)
    rows = values.collect()
    matrix = np.array([[r[n] for n in quality.NAMES] for r in rows])
    rules = quality.fit_rules(matrix, (matrix[:, 3] < 0.1).astype(float) * (matrix[:, 0] > 6))
    got = {r.doc_id: r.score for r in quality.scored(values, rules).collect()}
    assert [got[r.doc_id] for r in rows] == pytest.approx(rules.score(matrix).tolist())


def test_learns_only_from_rows_that_are_not_held_out(spark, docs):
    labels = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).cast("int").alias("quality"))
    rules = quality.learn(quality.with_statistics(docs), labels)
    assert rules.rules == [] and rules.intercept < 0  # it has seen zeros only


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 1), (None, 0)], "doc_id long, quality int")
    values = quality.with_statistics(odd)
    rules = quality.learn(values, labels)
    rows = quality.scored(values, rules).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.learn(values, labels.where("false")).intercept == 0
    assert quality.scored(quality.with_statistics(none), rules).count() == 0
    kept = quality.accepted(odd, quality.Rules([], 5.0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.accepted(odd, quality.Rules([], -5.0)).count() == 0


def test_hundreds_of_rules(spark, odd):
    rules = quality.Rules([(((i % 9, i % 2 == 0, i / 400), (3, True, 0.5)), 0.01) for i in range(600)], 1.0)
    assert quality.accepted(odd, rules).count() == odd.count()
    assert quality.scored(quality.with_statistics(odd), rules).count() == odd.count()
