"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes.

A text is split by the tokenizer's pattern, and every pre-token is looked up in two tiers. First a
minimal perfect hash over the vocabulary: pre-tokens are spread over buckets, every bucket has a
displacement that sends its words to slots of their own, and one comparison with the word in the
slot tells a hit from a miss. Misses are merged from single bytes: the bytes form a linked list, a
heap yields the adjacent pair of lowest rank (leftmost among equals), and entries that a merge has
outdated are skipped when they come up, so a pre-token of n bytes costs O(n log n).

The vocabulary, fixed in size, is broadcast. Results of recent pre-tokens are remembered in two
generations of ``MEMO`` entries; that saves time and changes nothing.

Defined cases. Null or empty text has no ids. Bytes that are not UTF-8 are replaced by U+FFFD
before encoding. Special tokens' strings are ordinary text. Null ids decode to null. Rows, other
columns and their order are kept; an existing column named as the new one is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convoy.llm.common import in_arrow, slices

MEMO = 1 << 19
CHUNK = 1 << 16
# Odd multipliers of a 64-bit mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
LOW64, LOW32 = (1 << 64) - 1, (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 word and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: each has a slot below their number."""

    def __init__(self, words: list[bytes], per_bucket: int = 4):
        self.size = len(words)
        self.n_buckets = max(1, self.size // per_bucket)
        for seed in range(64):
            if self._build(words, seed):
                return
        raise ValueError("no perfect hash found; are the words distinct?")

    def _build(self, words: list[bytes], seed: int) -> bool:
        self.seed = seed
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], dtype=np.uint64)
        size = np.uint64(max(1, self.size))
        bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        lengths = np.diff(starts)
        free = np.ones(self.size, dtype=bool)
        slot_of = np.zeros(self.n_buckets, dtype=np.int64)
        word_at = np.full(self.size, -1, dtype=np.int64)
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for b in np.argsort(-lengths, kind="stable"):
            if lengths[b] < 2:
                break
            members = order[starts[b] : starts[b + 1]]
            for first in range(0, 1 << 20, len(tries)):
                mixed = (hashes[members] + (tries + np.uint64(first)) * np.uint64(MIX[0])) * np.uint64(MIX[1])
                slots = ((mixed ^ (mixed >> np.uint64(31))) % size).astype(np.int64)
                sorted_slots = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (np.diff(sorted_slots, axis=1) > 0).all(axis=1)
                if good.any():
                    row = int(np.argmax(good))
                    slot_of[b] = first + row
                    free[slots[row]] = False
                    word_at[slots[row]] = members
                    break
            else:
                return False
        # A bucket of one word needs no search: it names its slot outright, as a negative number.
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(lengths == 1):
            slot = next(left)
            slot_of[b] = -1 - slot
            word_at[slot] = order[starts[b]]
        self.displacement = slot_of.tolist()
        self.word_at = word_at
        return True

    def slot(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        d = self.displacement[h % self.n_buckets]
        if d < 0:
            return -1 - d
        mixed = (h + d * MIX[0]) * MIX[1] & LOW64
        return (mixed ^ (mixed >> 31)) % self.size


class Vocabulary:
    """Ranks, the perfect hash over their words, and the pattern that splits text.

    Ranks are token ids; every single byte must have one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        words = list(ranks)
        self.hash = PerfectHash(words)
        self.slots = [(words[i], ranks[words[i]]) for i in self.hash.word_at.tolist()]
        self.words = {rank: word for word, rank in ranks.items()}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        # Ranks of pairs of tokens, and of pairs of single bytes by the bytes.
        self.byte_pairs = {(w[0], w[1]): rank for w, rank in ranks.items() if len(w) == 2}
        self.pairs: dict[int, int] = {}
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def pre_token(self, word: bytes) -> list[int]:
        found, rank = self.slots[self.hash.slot(word)]
        return [rank] if found == word else self.merged(word)

    def merged(self, word: bytes) -> list[int]:
        """Ids of ``word`` after merging adjacent pairs, lowest rank first, leftmost among equals."""
        rank_of, n, push, pop = self.pairs.get, len(word), heapq.heappush, heapq.heappop
        parts = [self.bytes[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The heap entry of the pair that now stands at a place; other entries of that place are outdated.
        standing = [-1] * n
        heap = []
        for i, pair in enumerate(zip(word, word[1:])):
            if (rank := self.byte_pairs.get(pair)) is not None:
                standing[i] = entry = rank << 32 | i
                heap.append(entry)
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & LOW32
            if standing[i] != top:
                continue
            rank, j = top >> 32, after[i]
            parts[i], parts[j], standing[i], standing[j] = rank, -1, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := rank_of(rank << 32 | parts[k])) is not None:
                    standing[i] = entry = new << 32 | i
                    push(heap, entry)
            h = before[i]
            if h >= 0:
                if (new := rank_of(parts[h] << 32 | rank)) is not None:
                    standing[h] = entry = new << 32 | h
                    push(heap, entry)
                else:
                    standing[h] = -1
        return [p for p in parts if p >= 0]


class Memo(dict[str, tuple[int, ...]]):
    """Ids of recent pre-tokens: two generations, of which the older one goes when the newer is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        known = self.older.get(word)
        if known is None:
            known = tuple(self.vocabulary.pre_token(word.encode()))
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = known
        return known


class Encoder:
    """Encodes texts one after another, remembering recent pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        pattern = regex.compile(vocabulary.pattern)
        self.split, self.split_whole = pattern.finditer, pattern.findall
        self.memo = Memo(vocabulary)

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of ``text``, so many at a time that a list of them stays small."""
        if len(text) <= CHUNK:
            yield self.split_whole(text)
            return
        found = map(itemgetter(0), self.split(text))
        while words := list(islice(found, CHUNK)):
            yield words

    def encode(self, text: str) -> np.ndarray:
        known = self.memo.__getitem__
        pieces = [np.fromiter(chain.from_iterable(map(known, words)), np.int32) for words in self.words(text)]
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int32)


_kept: list[Encoder] = []


def worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder: a later task starts with what earlier ones remember."""
    if not _kept or _kept[0].vocabulary is not vocabulary:
        _kept[:] = [Encoder(vocabulary)]
    return _kept[0]


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != column] + [T.StructField(column, kind)])


def _replaced(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != column]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [values], names=[*names, column])


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, encoder: Encoder, text_column: str, ids_column: str) -> Batches:
    for whole in batches:
        for batch in slices(whole, text_column, 1 << 20):
            texts = batch.column(text_column).cast(pa.binary())
            ids = [encoder.encode((t.as_py() or b"").decode("utf-8", "replace")) for t in texts]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield _replaced(batch, ids_column, values)


def _decoded(batches: Batches, words: dict[int, bytes], ids_column: str, bytes_column: str) -> Batches:
    for batch in batches:
        rows = (None if i is None else b"".join(map(words.__getitem__, i)) for i in _lists(batch, ids_column))
        yield _replaced(batch, bytes_column, pa.array(rows, pa.binary()))


def encode(df: DataFrame, vocabulary: Vocabulary, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``df`` with the token ids of its texts."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        yield from _encoded(batches, worker_encoder(shared.value), text_column, ids_column)

    return in_arrow(df, run, _with(df, ids_column, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its token ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.words)

    def run(batches: Batches) -> Batches:
        yield from _decoded(batches, shared.value, ids_column, bytes_column)

    return in_arrow(df, run, _with(df, bytes_column, T.BinaryType()))


def encode_decode(
    df: DataFrame, vocabulary: Vocabulary, text_column: str = "text", ids_column: str = "ids", bytes_column: str = "decoded"
) -> DataFrame:
    """``decode(encode(df))`` in one pass: a task needs one Python worker with one vocabulary instead of two."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        encoder = worker_encoder(shared.value)
        encoded = _encoded(batches, encoder, text_column, ids_column)
        yield from _decoded(encoded, encoder.vocabulary.words, ids_column, bytes_column)

    with_ids = _with(df, ids_column, T.ArrayType(T.IntegerType()))
    fields = [f for f in with_ids if f.name != bytes_column]
    return in_arrow(df, run, T.StructType([*fields, T.StructField(bytes_column, T.BinaryType())]))


def _lists(batch: pa.RecordBatch, column: str) -> Iterator[list[int] | None]:
    for value in batch.column(column):
        yield value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else None
