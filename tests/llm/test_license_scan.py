import random
import re

import pytest

from convoy.llm import license_scan
from convoy.llm.queries import op4_license_scan


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_places(text):
    found, all_words = [], words(text)
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        found += [(label, i) for i in range(len(all_words)) if all_words[i : i + len(parts)] == parts]
    return sorted(found, key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize(
    "text",
    ["MIT License MIT license-mit LICENSE", "the General Public License. É mit licenseé, mit_license [mit license", "", None,
     "apache\nlicense APACHE LICENSE apache licenses", "ÀMIT license"],
)
def test_words_and_places(text):
    got = license_scan.words_of((text or "").encode())
    assert [w.decode() for w in got] == words(text)
    assert license_scan.base_places(got) == brute_places(text)


@pytest.fixture(scope="module")
def index():
    vocabulary = {w for _, text, _ in license_scan.NOTICES for w in text.encode().split()}
    common = {b"the", b"of", b"to", b"and", b"a", b"in", b"is", b"with", b"or"}
    return license_scan.Index({w: 1.0 if w in common else 6.0 for w in vocabulary})


def labels(index, text):
    return [m[0] for m in index.matches(license_scan.words_of(text.encode()))]


def test_every_notice_finds_itself(index):
    for label, text, _ in license_scan.NOTICES:
        noise = "zzz " * 300
        found = {m[0]: m for m in index.matches(license_scan.words_of((noise + text + " " + noise).encode()))}
        assert found[label][1] == pytest.approx(1.0)
        assert found[label][2] <= 300 + license_scan.SLACK


def test_wrapped_and_shortened_notice(index):
    text = license_scan.NOTICES[0][1].replace("copy modify", "copy, * modify").replace("associated ", "")
    assert labels(index, text) == ["mit-notice"]


def test_scattered_words_and_missing_phrases(index):
    text = license_scan.NOTICES[8][1].split()
    assert labels(index, (" zzz " * 20).join(text)) == []
    assert "bsd-notice" not in labels(index, " ".join(text).replace("binary forms", "binary xforms"))
    assert labels(index, "nothing to see here") == []


@pytest.mark.parametrize("noise", ["", " zzz" * 40, " the license of this software is free to use and copy" * 40])
def test_a_document_that_holds_all_notices(noise):
    vocabulary = {w for _, text, _ in license_scan.NOTICES for w in text.encode().split()}
    for weights in ({w: 5.0 for w in vocabulary}, {w: 1.0 + len(w) for w in vocabulary}):
        index = license_scan.Index(weights)
        for held in (license_scan.NOTICES, license_scan.NOTICES[::-1], [license_scan.NOTICES[i] for i in (0, 8, 10)]):
            text = noise.join(f" {text} " for _, text, _ in held)
            found = {m[0]: m[1] for m in index.matches(license_scan.words_of(text.encode()))}
            assert all(found.get(label) == pytest.approx(1.0) for label, _, _ in held)


def test_matches_are_those_of_a_scan_of_every_word():
    """Against all votes of all indexed words, without proposals, on random words of the notices."""
    rng = random.Random(4)
    vocabulary = sorted({w for _, text, _ in license_scan.NOTICES for w in text.encode().split()})
    index = license_scan.Index({w: rng.choice([1.0, 2.5, 6.0]) for w in vocabulary})
    seen = 0
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 12)):
            notice = rng.choice(license_scan.NOTICES)[1].encode().split()
            words += [w for w in notice if rng.random() > 0.08] + rng.choices(vocabulary, k=rng.randrange(15))
        want = []
        for number, postings in enumerate(index.postings):
            votes = [(i - at, w) for i, w in enumerate(words) for at in postings.get(w, ())]
            best = index._best(number, votes, words)
            want += [(license_scan.NOTICES[number][0], *best)] if best else []
        assert index.matches(words) == sorted(want)
        seen += len(want)
    assert seen > 100


def test_frame(spark, odd, none):
    rows = {r.doc_id: r for r in license_scan.scan(odd).collect()}
    assert rows[1].n_words == rows[2].n_words == 0 and rows[1].places == [] and rows[1].matches == []
    assert rows[6].n_words == 60_000
    assert license_scan.scan(none).count() == 0


def test_query(spark, sf, texts):
    rows = op4_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    frequencies, total = license_scan.document_frequencies(spark.read.parquet(f"{sf}/documents.parquet"))
    assert total == len(texts)
    assert frequencies[b"license"] == sum("license" in words(t) for t in texts.values())
    for r in rows:
        places = brute_places(texts[r.doc_id])
        at = [p for _, p in places]
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        base = sorted({label for label, _ in places})
        assert r.base_labels == ",".join(base) and set(base) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
