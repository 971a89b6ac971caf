import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from convoy.llm import periodic_runs as pr
from convoy.llm.queries import op11_periodic_runs


def direct(words, min_length=12):
    """Every run by comparing words at every distance."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        same = [words[j] == words[j + q] for j in range(len(words) - q)]
        j = 0
        while j < len(same):
            k = j
            while k < len(same) and same[k]:
                k += 1
            length = k - j + q
            run = words[j : j + length]
            if k > j and length >= max(min_length, 2 * q) and all(run[d:] != run[:-d] for d in range(1, q)):
                out.append((j, length, q))
            j = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    words = []
    letters = rng.choice([1, 2, 3, 5, 30])
    for _ in range(rng.randint(1, 6)):
        block = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([3, 8, 25])))]
        words += block * rng.choice([1, 1, 2, 3, 5]) + block[: rng.randrange(len(block) + 1)]
        if rng.random() < 0.4:
            words += [rng.randrange(100, 130) for _ in range(rng.randint(0, 5))]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [made(rng) for _ in range(rng.randint(1, 5))]
        rows = np.append(0, np.cumsum([len(d) for d in docs]))
        least = rng.choice([2, 4, 7, 12])
        got = pr.find_runs(np.array([w for d in docs for w in d], np.int64), rows, least)
        assert got == [direct(d, least) for d in docs]


def test_words_with_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert pr.find_runs(np.array(b), np.array([0, len(b)]))[0] == direct(b)
    assert pr.find_runs(np.zeros(50_000, np.int64), np.array([0, 50_000]))[0] == [(0, 50_000, 1)]


def test_automaton_gives_last_occurrences():
    rng = random.Random(9)
    for _ in range(60):
        text = [rng.randrange(3) for _ in range(30)]
        automaton = pr.LinkCutAutomaton()
        for end, symbol in enumerate(text, 1):
            found = dict()
            for before, reach in automaton.append(symbol, 1):
                found[before] = max(found.get(before, 0), reach)
            want = {}
            for n in range(1, end):
                last = [e for e in range(n, end) if text[e - n : e] == text[end - n : end]]
                if last:
                    want[last[-1]] = max(want.get(last[-1], 0), n)
            assert found == want


def test_query_against_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in op11_periodic_runs(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) > 1_500:
            continue
        runs, mine = direct(words), got[r.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (mine.n_runs, mine.start, mine.length, mine.period) == (len(runs), *best)
        assert mine.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert mine.runs_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert mine.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        some += len(runs)
    assert some > 5


def test_odd_rows(spark, odd, none):
    clashing = odd.withColumns({"words": odd.size, "runs": odd.size, "row": odd.size, "g": odd.size, "n_words": odd.size})
    rows = pr.collapse(clashing).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0 and by_id[1].collapsed == ""
    assert by_id[6].runs == [(0, 60_000, 1)] and by_id[6].collapsed == "word"
    assert by_id[8].collapsed == "é ü 漢字 \xa0 x" and by_id[None].collapsed == "no id"
    assert pr.collapse(none).count() == 0
    planted = pr.repeat_tails(clashing)
    assert planted.columns == clashing.columns and planted.count() == odd.count()
