import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from convoy.llm import bpe
from convoy.llm.queries import RANKS, op2_bpe, vocabulary


@pytest.fixture(scope="module")
def known():
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_word_has_its_own_slot():
    words = vocabulary()
    slots = {words.hash.slot(w) for w in words.ranks}
    assert slots == set(range(len(words.ranks)))
    assert all(words.pre_token(w) == [r] for w, r in words.ranks.items())


@settings(max_examples=150, deadline=None)
@given(st.text() | st.text("ab '\n") | st.text("ßéö漢字"))
def test_encodes_as_the_library(text):
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary().ranks, special_tokens={}
    )
    assert bpe.Encoder(vocabulary()).encode(text).tolist() == known.encode_ordinary(text)


def test_long_words(known):
    for text in ("a" * 30_000, "ab" * 9_000 + " " * 5_000, "é" * 4_000):
        assert bpe.Encoder(vocabulary()).encode(text).tolist() == known.encode_ordinary(text)


def test_memo_changes_nothing(known, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    encoder, text = bpe.Encoder(vocabulary()), "zzqx qwrt plkm zzqx vbnm qwrt zzqx hgfd jklz qwrt"
    assert encoder.encode(text).tolist() == known.encode_ordinary(text)
    assert len(encoder.memo) <= 3


def test_round_trip(spark, odd, known):
    out = bpe.decode(bpe.encode(odd, vocabulary()), vocabulary()).collect()
    assert len(out) == odd.count()
    for r in out:
        assert list(r.ids) == known.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_clashing_and_empty(spark, none):
    df = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, ids string")
    assert bpe.encode(df, vocabulary()).dtypes[-1] == ("ids", "array<int>")
    assert bpe.decode(bpe.encode(none, vocabulary()), vocabulary()).count() == 0


def test_query(spark, sf, texts, known):
    import hashlib

    for r in op2_bpe(spark, sf).collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_one_pass(spark, odd):
    both = bpe.decode(bpe.encode(odd, vocabulary()), vocabulary())
    once = bpe.encode_decode(odd, vocabulary())
    assert once.dtypes == both.dtypes
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, both.collect()), key=repr)
    clashing = odd.withColumnRenamed("source", "decoded").withColumnRenamed("size", "ids")
    assert bpe.encode_decode(clashing, vocabulary()).columns == ["doc_id", "text", "ids", "decoded"]
