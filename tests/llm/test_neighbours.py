import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import neighbours
from convoy.llm.queries import op9_neighbours


def brute(vectors, queries, k):
    """{query: [(id, score)]} over {id: vector}, by inner product, ties to the smaller id."""
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids])
    out = {}
    for q in queries:
        scores = matrix @ np.array(vectors[q])
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != q][:k]
        out[q] = [(ids[j], scores[j]) for j in order]
    return out


def frame(spark, vectors):
    rows = [(int(i), [float(x) for x in v]) for i, v in vectors.items()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    y = neighbours.rotated(x, 3, 9)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-3)
    own = neighbours.nearest_axes(x, 3, 1, 9)[:, 0]
    assert all(abs(y[i, c % 64]) == np.abs(y[i]).max() and (y[i, c % 64] < 0) == (c >= 64) for i, c in enumerate(own))


def test_recall_and_scores_on_the_table(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = by_query(op9_neighbours(spark, sf).collect())
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, score in found:
            assert score == pytest.approx(np.dot(np.array(vectors[i]), np.array(vectors[q])), abs=1e-12)


def test_exact_with_every_probe_norms_ties_and_small_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=10) * rng.choice([0.1, 1, 5]) for i in range(150)}
    vectors |= {i: vectors[7] for i in range(150, 190)}  # a hot cell of equal vectors
    got = by_query(
        neighbours.search(frame(spark, vectors), F.col("id") % 10 == 0, k=25, tables=1, probes=99, block=8).collect()
    )
    want = brute(vectors, range(0, 190, 10), 25)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=24) * rng.uniform(0.2, 3) for i in range(1500)}
    got = by_query(neighbours.search(frame(spark, vectors), F.col("id") % 50 == 0, k=10).collect())
    want = brute(vectors, range(0, 1500, 50), 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


@pytest.mark.parametrize("scales", ["one row", "half to one and a half", "log-normal", "hubs"])
def test_recall_in_64_dimensions_with_unequal_norms(spark, scales):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(2000, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    if scales == "one row":
        matrix[7] *= 3
    elif scales == "half to one and a half":
        matrix *= rng.uniform(0.5, 1.5, (2000, 1))
    elif scales == "log-normal":
        matrix *= rng.lognormal(0, 1, (2000, 1))
    else:
        matrix[::100] *= 50
    vectors = dict(enumerate(matrix))
    got = by_query(neighbours.search(frame(spark, vectors), F.col("id") % 40 == 1, k=20).collect())
    want = brute(vectors, range(1, 2000, 40), 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_reached_cosine():
    assert neighbours.reached(64, 7, 128, 0.9) == -1.0
    few, many = neighbours.reached(64, 7, 4, 0.9), neighbours.reached(64, 7, 16, 0.9)
    assert 0 < many < few < 1 and neighbours.reached(64, 7, 16, 0.99) > many


def test_fewer_than_k_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 9), (1, [0.5, 0.5], 9), (1, [0.5, 0.5], 9), (2, None, 9), (3, [0.0, 0.0], 9), (4, [nan, 1.0], 9),
            (5, [1.0, None], 9), (6, [inf, 0.0], 9), (7, [], 9), (None, [1.0, 1.0], 9), (8, [-1.0], 9), (20, [0.5, 0.5, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = by_query(neighbours.search(df.drop("id"), F.col("id") % 20 == 0).collect())
    assert got == {0: [(1, 0.5), (20, 0.5), (8, -1.0)], 20: [(0, 0.5), (1, 0.5), (8, -0.5)]}
    assert neighbours.search(df, F.col("id") == 0).count() == 3
    assert neighbours.search(df.where("false"), F.col("id") == 0).count() == 0
