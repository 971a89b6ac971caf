import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convoy.llm import mixing


def filled(sizes, share, epochs, weights):
    """Targets by rounds of clamping; ``sizes`` in source order."""
    total, capped = share * sum(sizes), set()
    while True:
        left = total - sum(epochs * sizes[i] for i in capped)
        weight = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in capped)
        out = [epochs * s if i in capped else left * weights[i % len(weights)] / weight for i, s in enumerate(sizes)]
        more = {i for i in range(len(sizes)) if i not in capped and out[i] > epochs * sizes[i] * (1 + 1e-12)}
        if not more:
            return out
        capped |= more


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, 1.5, 2.0, mixing.WEIGHTS).collect()}
    want = filled(sizes, 1.5, 2.0, mixing.WEIGHTS)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_words_come_near_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert len(rows) == docs.count()
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_drawn_in_seeded_order(docs, texts):
    """Within a source, every document drawn once more precedes, by MD5, every one that is not."""
    rows = sorted(mixing.mix(docs, seed="s").collect(), key=lambda r: hashlib.md5(f"s:{r.doc_id}".encode()).hexdigest())
    for source in {r.source for r in rows}:
        repeats = [r.repeats for r in rows if r.source == source]
        assert repeats == sorted(repeats, reverse=True)


def test_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(tuple, mixing.mix(odd).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(none).count() == 0


def test_all_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(df).collect()] == [(0.0, 0), (0.0, 0)]


def test_no_ids_and_repeated_rows(spark):
    """Rows without an id, rows that share one and repeated rows give the same mix in any layout."""
    rows = [(None, f"{'w ' * (i % 7)}{i}", "ab"[i % 2]) for i in range(600)]
    rows += [(7, f"{'v ' * (i % 5)}{i}", "a") for i in range(200)] + [(8, "x y z", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clashing = df.selectExpr("*", "1 as draw", "2 as tie", "3 as size", "4 as edge", "5 as last", "6 as whole", "7 as row")
    first = sorted(map(tuple, mixing.mixed(clashing.repartition(3)).collect()), key=repr)
    again = sorted(map(tuple, mixing.mixed(clashing.repartition(7, "text")).collect()), key=repr)
    assert first == again and len(first) > 0
    taken = [len(r[1].split()) for r in first]
    words = sum(len(r[1].split()) for r in rows)
    assert abs(sum(taken) - 1.5 * words) <= 2 * max(len(r[1].split()) for r in rows) * 3
    assert sum(r[0] is None for r in first) > 0
