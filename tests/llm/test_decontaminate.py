import random
import re

import numpy as np

from convoy.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def direct(texts, items, size=10):
    """(n_words, spans, items) of every text by looking for every window at every place."""
    windows = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        spans = [[i, i + 1] for i in sorted(hit)]
        merged = []
        for s in spans:
            if merged and merged[-1][1] == s[0]:
                merged[-1][1] = s[1]
            else:
                merged.append(s)
        out.append((len(w), [tuple(s) for s in merged], sorted(str(x) for x in found if x is not None)))
    return out


def test_index_against_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(60):
        docs = [[rng.randrange(1, rng.choice([3, 6, 40])) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 6))]
        docs += docs[:2]
        text = np.array([x for d in docs for x in [*d, 0]], np.int32)
        ends = np.flatnonzero(text == 0)

        def key(i):
            end = ends[np.searchsorted(ends, i)]
            return [*(text[i:end] + 1_000), np.searchsorted(ends, end)]

        order = dc.sorted_suffixes(text)
        assert order.tolist() == sorted(range(len(text)), key=key)
        index = dc.Index.read(dc.Index.build(text, sampled=rng.choice([1, 3, 8])))
        assert index.locate(np.arange(len(text))).tolist() == order.tolist()
        windows = []
        for _ in range(20):
            d = rng.choice(docs)
            i, n = rng.randrange(len(d)), rng.randint(1, 5)
            windows.append((d[i : i + n] + [-1] * 5)[:5])
            windows.append([rng.randrange(1, int(text.max()) + 1) for _ in range(3)] + [-1, -1])
        alive, low, high = index.search(np.array(windows, np.int32))
        got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(alive, low, high, strict=True)}
        whole = text.tolist()
        for k, window in enumerate(windows):
            w = [x for x in window if x >= 0]
            assert got.get(k, []) == [i for i in range(len(whole)) if whole[i : i + len(w)] == w]


def test_table_against_brute_force(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r for r in dc.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    for r, want in zip(rows, direct([r.text for r in rows], items), strict=True):
        mine = found[r.doc_id]
        assert (mine.n_words, [tuple(s) for s in mine["spans"]], mine["items"]) == want
    assert sum(bool(r["spans"]) for r in found.values()) >= 3


def test_short_shards_long_rows_and_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(1, passage), (2, "Short ITEM"), (3, passage + " more"), (4, None), (5, "--"), (None, "x1 x2 x3")]
    texts = []
    for _ in range(40):
        w = [f"x{rng.randrange(6)}" for _ in range(rng.randrange(120))]
        for extra in (passage, "short, item", passage.upper()):
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w) + 1), extra)
        texts.append(" ".join(w))
    table = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK", 20)
    index = dc.build_index(table, most=64)
    assert index.count() > 20 and index.agg({"n": "max"}).first()[0] <= 64
    found = {r.row_id: r for r in dc.find(index, bench).collect()}
    rows = index.selectExpr("inline(docs)").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, spans, names = direct([texts[r.doc_id]], items)[0]
        assert r.n_words == n
        mine = found.get(r.row_id)
        assert ([tuple(s) for s in mine["spans"]] if mine else []) == spans
        assert [x for x in mine["items"] if x is not None] == names if mine else not names


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([("a", "Same text"), ("b", "word " * 30), ("c", None)], "item_id string, text string")
    clashing = odd.withColumns({"row_id": odd.size, "items": odd.size, "docs": odd.size, "n": odd.size})
    rows = dc.contamination(clashing, bench).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r for r in rows}
    assert found[1].n_words == 0 and found[1]["items"] == [] and found[None]["spans"] == []
    assert found[4]["spans"] == [(0, 2)] and found[5]["items"] == ["a"]
    assert found[6]["spans"] == [(0, 60_000)] and found[7]["items"] == ["b"]
    assert dc.contamination(none, bench).count() == 0
    nothing = dc.contamination(odd, bench.where("false"))
    assert nothing.where("size(spans) > 0").count() == 0 and nothing.count() == odd.count()
