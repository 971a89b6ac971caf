import random
import re

import numpy as np
import pytest

from convoy.llm import jaccard_join
from convoy.llm.components import components
from convoy.llm.queries import op7_jaccard_join


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, threshold=0.8):
    """{doc_id: (class_id, rep_id, n_links)} of {doc_id: text}."""
    sets = {i: grams(t) for i, t in docs.items()}
    ids = sorted(sets)
    near = {i: [] for i in ids}
    holders = {}
    for i in ids:
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    for i in ids:
        for j in {j for g in sets[i] for j in holders[g] if j > i}:
            shared = len(sets[i] & sets[j])
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                near[i].append(j)
                near[j].append(i)
    root = {}
    for i in ids:
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += near[k]
    return {i: (root[i], min([i, *(j for j in near[i] if sets[j] == sets[i])]), len(near[i])) for i in ids}


def result(df, **options):
    return {r.doc_id: (r.class_id, r.rep_id, r.n_links) for r in jaccard_join.jaccard_join(df, **options).collect()}


def varied(seed, n=120, words=60):
    """Groups of copies and near copies: every document changes a few words of an earlier one, or none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    out = [[word() for _ in range(words)]]
    for _ in range(n - 1):
        text = list(rng.choice(out[-20:])) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, words))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            if text:
                text[rng.randrange(len(text))] = word()
        out.append(text)
    return {i: " ".join(t) for i, t in enumerate(out)}


@pytest.mark.parametrize("blocks", [1024, 7])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", blocks)
    docs = varied(blocks)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert result(df) == brute(docs)


def test_query(spark, sf, texts):
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_links) for r in op7_jaccard_join(spark, sf).collect()}
    assert got == brute(texts)


def test_banding_meets_recall():
    bands, rows = jaccard_join.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(70)]
    owner = np.repeat(np.arange(70), [len(s) for s in sets])
    got = jaccard_join.shared_counts(np.concatenate(sets), owner, 70)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(70, dtype=bool)
    assert (got[off] == want[off]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 77), (77, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 77: 50, 100: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark, odd, none):
    rows = [tuple(r)[:4] for r in jaccard_join.jaccard_join(odd).select("doc_id", "class_id", "rep_id", "n_links").collect()]
    assert sorted(rows, key=repr) == sorted(
        [(1, 1, 1, 0), (2, 2, 2, 0), (3, 3, 3, 0), (4, 4, 4, 2), (5, 4, 4, 2), (5, 4, 4, 2), (6, 6, 6, 1), (7, 6, 6, 1),
         (8, 8, 8, 0), (9, 9, 9, 0), (None, None, None, 0)], key=repr)
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert jaccard_join.jaccard_join(none).count() == 0
