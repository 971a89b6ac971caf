"""Both removers of repeats against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pytest

from convoy.llm import repeats, substring_dedup, suffix_dedup
from convoy.llm.queries import op1_suffix_dedup, op5_substring_dedup


def brute(docs, size):
    """docs: (doc_id, tokens) in order of doc_id; the removed flags of every document."""
    seen, out = set(), {}
    for doc_id, tokens in docs:
        flags = [False] * len(tokens)
        for i in range(len(tokens) - size + 1):
            window = tuple(tokens[i : i + size])
            if window in seen:
                flags[i : i + size] = [True] * size
            seen.add(window)
        out[doc_id] = flags
    return out


def spans(flags):
    edges = np.flatnonzero(np.diff(np.array([0, *map(int, flags), 0])))
    return [tuple(map(int, x)) for x in edges.reshape(-1, 2)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made_up(seed, unit, n=60):
    """Documents with copies, shared passages, passages that touch, and periodic stretches."""
    rng = random.Random(seed)
    draw = lambda k: "".join(rng.choice(unit) for _ in range(k))
    shared = [draw(40) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [rng.choice([draw(rng.randint(0, 60)), rng.choice(shared), rng.choice(unit) * rng.randint(0, 40)])
                 for _ in range(rng.randint(0, 5))]
        out.append(rng.choice(out) if out and rng.random() < 0.2 else "".join(parts))
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "gram", "slice_", "chunk"), [(12, 4, 2 << 20, 1 << 20), (10, 2, 100, 64), (6, 2, 500, 97)])
def test_bytes(spark, monkeypatch, size, gram, slice_, chunk):
    monkeypatch.setattr(repeats, "SLICE", slice_)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = made_up(size, ["a", "b", "é", " "])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, size, gram).collect()}
    want = brute([(i, t.encode()) for i, t in rows], size)
    assert len(got) == len(rows)
    for i, text in rows:
        data = text.encode()
        assert [tuple(s) for s in got[i].removed] == spans(want[i])
        assert bytes(got[i].kept) == bytes(b for b, gone in zip(data, want[i], strict=True) if not gone)
        assert got[i].n_tokens == len(data)


@pytest.mark.parametrize(("size", "gram", "slice_", "chunk"), [(6, 2, 2 << 20, 1 << 20), (5, 4, 100, 29)])
def test_words(spark, monkeypatch, size, gram, slice_, chunk):
    monkeypatch.setattr(repeats, "SLICE", slice_)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = made_up(size, ["a ", "b\n", "é\t ", " c ", " d "])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, size, gram).collect()}
    want = brute([(i, words(t)) for i, t in rows], size)
    for i, text in rows:
        assert [tuple(s) for s in got[i].removed] == spans(want[i])
        kept = " ".join(w for w, gone in zip(words(text), want[i], strict=True) if not gone)
        assert bytes(got[i].kept).decode() == kept
        assert got[i].n_tokens == len(words(text))


def test_one_hot_anchor_over_many_buckets(spark):
    """A passage in every document, between texts of their own: its anchors span all buckets."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(50))
    rows = [(i, "".join(rng.choice("xyzuvw") for _ in range(30)) + passage) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute([(i, t.encode()) for i, t in rows], 20)
    for r in suffix_dedup.remove_repeats(df, 20, 4).collect():
        assert [tuple(s) for s in r.removed] == spans(want[r.doc_id])


def test_word_tokens_cut_at_rows():
    flat = np.frombuffer("ab c\nd ef".encode(), np.uint8)
    tokens = repeats.word_tokens(flat, np.array([0, 0, 1, 5, 5, 9]))
    assert bytes(tokens.text) == b"a b c d ef "
    assert tokens.rows.tolist() == [0, 0, 1, 3, 3, 5]


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats])
def test_odd_rows(spark, odd, none, remove):
    rows = remove(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 0
    assert by_id[6].removed[0].begin > 0  # periodic: all but its first windows
    assert len(by_id[7].removed) == 1 and bytes(by_id[7].kept) == b""
    assert remove(none).count() == 0


def test_queries(spark, sf, docs, texts):
    order = sorted(texts)
    want = brute([(i, texts[i].encode()) for i in order], 100)
    for r in op1_suffix_dedup(spark, sf).collect():
        data, flags = texts[r.doc_id].encode(), want[r.doc_id]
        kept = bytes(b for b, gone in zip(data, flags, strict=True) if not gone)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(flags), len(spans(flags)))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    want = brute([(i, words(texts[i])) for i in order], 20)
    for r in op5_substring_dedup(spark, sf).collect():
        every, flags = words(texts[r.doc_id]), want[r.doc_id]
        kept = " ".join(w for w, gone in zip(every, flags, strict=True) if not gone)
        assert (r.n_words, r.n_removed) == (len(every), sum(flags))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
