"""Benchmark decontamination: passages of test items found in training texts through an FM-index.

Training texts are cut into shards of at most ``SHARD`` words. A shard's words are numbered by its
own vocabulary, its suffixes are sorted, and what is kept of them is an FM-index: the words before
the sorted suffixes as a wavelet matrix, the counts of smaller words, and the places of sampled
suffixes. The index is a written table of one row per shard and can be searched again.

Test items give windows of ``size`` consecutive words; an item of fewer words, but not none, is one
window. All windows are searched backwards at once, word by word, by ranks in the wavelet matrix.
What is left of a window's range is located by stepping back to the nearest sampled suffix. Windows
found are merged into spans of words.

- Suffixes are sorted whole: prefixes of 1, 2, 4, ... words are ranked by sorting one packed 64-bit
  number per suffix, and from four words on only what still ties is sorted again. Every row's end is a
  symbol of its own, so a tie ends where the text does, and copies cost no more than their length.
- Where a row begins is sampled besides every ``SAMPLED``-th place, so stepping back never leaves it.
- A row of more words than a shard holds is cut into pieces that overlap by ``size - 1`` words.
- Items reach the tasks in blocks of about ``BLOCK`` bytes, one pass over the index for each, so
  nothing that is broadcast grows with the benchmark.
- A shard's vocabulary holds its words as bytes, and the items' words are looked up by bytes.

Shards are made where the rows are, so no text is shuffled; only the hits of a row are brought
together, and a row is one key.

Defined cases. Null texts have no words, on both sides. Rows that repeat ``doc_id`` are separate
rows. Items that repeat ``item_id`` are one item. Items without an id are one item,
a null in the list of ids. Empty tables give no rows, or no hits. Of the other columns none is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm import words as wd
from convoy.llm.common import buffers, in_arrow, slices, stored, text_or_empty

SIZE = 10
SHARD = 1 << 20
SAMPLED = 8
BLOCK = 4 << 20
SLICE = 4 << 20
# Occurrences located at once.
CHUNK = 1 << 18
# Words of an item in one piece.
PIECE = 20_000


# --- The index of one shard ---------------------------------------------------------------------


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` in order; 0 marks ends of rows, earlier ones being smaller."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(n + 1).bit_length())
    if 3 * bits > 63:
        raise ValueError(f"a shard of {n} words is too long")
    low = (1 << bits) - 1
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    span, live = 1, np.arange(n)
    order = np.empty(n, np.int64)
    while True:
        after = np.where(live + span < n, rank[np.minimum(live + span, n - 1)] + 1, 0)
        packed = np.sort((rank[live] << (2 * bits)) | (after << bits) | live)
        at = packed & low
        group, pair = packed >> (2 * bits), packed >> bits
        # A group's members stand from its rank on, as the rank counts smaller suffixes.
        head = np.append(True, group[1:] != group[:-1])
        if span == 1:
            where = np.arange(n)
        else:
            heads = np.flatnonzero(head)
            where = np.repeat(group[heads] - heads, np.diff(np.append(heads, len(at)))) + np.arange(len(at))
        order[where] = at
        new = np.append(True, pair[1:] != pair[:-1])
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(at)))
        rank[at] = np.repeat(where[firsts], sizes)
        live = at[np.repeat(sizes > 1, sizes)]
        span *= 2
        if not len(live):
            return order


@dataclass
class Index:
    """An FM-index over numbered words; 0 ends a row."""

    n: int
    smaller: np.ndarray
    levels: np.ndarray
    counts: np.ndarray
    zeros: np.ndarray
    marked: np.ndarray
    marks: np.ndarray
    places: np.ndarray

    @staticmethod
    def build(text: np.ndarray, sampled: int = SAMPLED) -> dict[str, bytes | int]:
        """What is stored of the index: packed levels, marks of sampled suffixes, and their places."""
        n = len(text)
        order = sorted_suffixes(text)
        before = text[order - 1]
        size = int(text.max(initial=0)) + 1
        depth = max(1, (size - 1).bit_length())
        levels, zeros = np.zeros((depth, -(-n // 8)), np.uint8), np.zeros(depth, np.int64)
        left = before
        for k in range(depth):
            bit = (left >> (depth - 1 - k)) & 1
            levels[k] = np.packbits(bit.astype(np.uint8))
            ones = bit.astype(bool)
            zeros[k] = n - int(np.count_nonzero(ones))
            left = np.concatenate([left[~ones], left[ones]])
        first = (order % sampled == 0) | (before == 0)
        return {
            "n": n,
            "depth": depth,
            "smaller": np.append(0, np.cumsum(np.bincount(text, minlength=size))).astype(np.int32).tobytes(),
            "levels": levels.tobytes(),
            "zeros": zeros.astype(np.int32).tobytes(),
            "marked": np.packbits(first.astype(np.uint8)).tobytes(),
            "places": order[first].astype(np.int32).tobytes(),
        }

    @staticmethod
    def read(row: dict) -> Index:
        n, depth = row["n"], row["depth"]
        packed = np.frombuffer(row["levels"], np.uint8).reshape(depth, -1)
        levels = np.unpackbits(packed, axis=1, count=n) if n else np.zeros((depth, 0), np.uint8)
        counts = np.zeros((depth, n + 1), np.int32)
        np.cumsum(levels, axis=1, out=counts[:, 1:])
        marked = np.unpackbits(np.frombuffer(row["marked"], np.uint8), count=n)
        return Index(
            n,
            np.frombuffer(row["smaller"], np.int32),
            levels,
            counts,
            np.frombuffer(row["zeros"], np.int32),
            marked,
            np.append(0, np.cumsum(marked)).astype(np.int32),
            np.frombuffer(row["places"], np.int32),
        )

    def ranks(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``word`` stands among the first ``low`` and the first ``high`` words of the matrix."""
        none = np.zeros(len(word), np.int32)
        depth = len(self.zeros)
        for k in range(depth):
            count, bit = self.counts[k], ((word >> (depth - 1 - k)) & 1).astype(bool)
            none, low, high = (
                np.where(bit, self.zeros[k] + count[x], x - count[x]) for x in (none, low, high)
            )
        return low - none, high - none

    def step(self, at: np.ndarray) -> np.ndarray:
        """For sorted suffixes, where the suffixes that begin one word earlier stand."""
        place, low = at.astype(np.int32), np.zeros(len(at), np.int32)
        word = np.zeros(len(at), np.int32)
        for k in range(len(self.zeros)):
            count, bit = self.counts[k], self.levels[k][place]
            ones, ones_low = count[place], count[low]
            place = np.where(bit, self.zeros[k] + ones, place - ones)
            low = np.where(bit, self.zeros[k] + ones_low, low - ones_low)
            word = word * 2 + bit
        return self.smaller[word] + place - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (rows of words, ended by -1 where short) that occur: their numbers and ranges."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int32), np.full(len(windows), self.n, np.int32)
        for j in range(windows.shape[1] - 1, -1, -1):
            word = windows[alive, j]
            some = word >= 0
            word = np.where(some, word, 0)
            below, upto = self.ranks(word, low, high)
            new_low = np.where(some, self.smaller[word] + below, low)
            new_high = np.where(some, self.smaller[word] + upto, high)
            left = new_low < new_high
            alive, low, high = alive[left], new_low[left], new_high[left]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The places in the text of sorted suffixes."""
        out = np.zeros(len(at), np.int64)
        left, steps = np.arange(len(at)), 0
        at = at.astype(np.int32)
        while len(left):
            found = self.marked[at].astype(bool)
            out[left[found]] = self.places[self.marks[at[found]]] + steps
            left, at = left[~found], at[~found]
            at = self.step(at) if len(at) else at
            steps += 1
        return out


# --- The index of a table -----------------------------------------------------------------------

_BINARY = ("smaller", "levels", "zeros", "marked", "places", "vocabulary", "lengths", "begins", "firsts")


def _shard_type(id_type: pa.DataType) -> pa.Schema:
    """A shard: its index, its vocabulary, where its rows' pieces begin, and the rows that end in it."""
    row = pa.struct([("row_id", pa.int64()), ("doc_id", id_type), ("n_words", pa.int64())])
    return pa.schema(
        [("n", pa.int32()), ("depth", pa.int32())]
        + [(c, pa.binary()) for c in _BINARY]
        + [("row_ids", pa.list_(pa.int64())), ("docs", pa.list_(row))]
    )


@dataclass
class _Open:
    """Rows gathered for the next shard: their words, the places of their pieces, and what they are."""

    words: list[pa.Array] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    firsts: list[int] = field(default_factory=list)
    row_ids: list[int] = field(default_factory=list)
    docs: list[dict] = field(default_factory=list)
    held: int = 0

    def add(self, words: pa.Array, lengths: np.ndarray, row_ids: list[int], first: int = 0) -> None:
        """Rows of ``lengths`` words each, none of them empty, whose first word is their word ``first``."""
        self.words.append(words)
        self.begins += (np.cumsum(lengths + 1) - lengths - 1 + self.held).tolist()
        self.firsts += [first] * len(lengths)
        self.row_ids += row_ids
        self.held += len(words) + len(lengths)

    def shard(self, schema: pa.Schema) -> pa.RecordBatch:
        coded = pa.concat_arrays(self.words or [pa.array([], pa.large_binary())]).dictionary_encode()
        text = np.zeros(self.held, np.int32)
        inside = np.ones(self.held, dtype=bool)
        if self.held:
            inside[np.append(self.begins[1:], self.held).astype(np.int64) - 1] = False
        text[inside] = coded.indices.to_numpy().astype(np.int32) + 1
        data, offsets = buffers(coded.dictionary)
        row = {
            **Index.build(text),
            "vocabulary": data.tobytes(),
            "lengths": np.diff(offsets).astype(np.int32).tobytes(),
            "begins": np.array(self.begins, np.int32).tobytes(),
            "firsts": np.array(self.firsts, np.int64).tobytes(),
            "row_ids": self.row_ids,
            "docs": self.docs,
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)


def build_index(
    docs: DataFrame, size: int = SIZE, most: int = SHARD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The index over ``docs``, written to the shared folder: shards of at most ``most`` words and end marks."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_column).alias("doc_id"),
        text_or_empty(text_column).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} binary" for c in _BINARY)
    schema = f"n int, depth int, {columns}, row_ids array<bigint>, docs array<struct<row_id:bigint,doc_id:{kind},n_words:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, arrow = _Open(), None
        for whole in batches:
            arrow = arrow or _shard_type(whole.schema.field("doc_id").type)
            for batch in slices(whole, "text", SLICE):
                held = wd.split(*buffers(batch.column("text")), wd.ALNUM, wd.LOWER)
                flat = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(held.at) - 1, [None, pa.py_buffer(held.at), pa.py_buffer(held.text)]
                )
                ids, lengths = batch.column("row_id").to_pylist(), np.diff(held.rows)
                docs = batch.select(["row_id", "doc_id"]).append_column("n_words", pa.array(lengths)).to_pylist()
                r = 0
                while r < len(ids):
                    # As many whole rows as there is room for.
                    room = np.cumsum(lengths[r:] + 1)
                    fit = int(np.searchsorted(room, most - open_.held, side="right"))
                    if fit:
                        some = np.flatnonzero(lengths[r : r + fit]) + r
                        if len(some):
                            words = flat.slice(int(held.rows[r]), int(held.rows[r + fit] - held.rows[r]))
                            open_.add(words, lengths[some], [ids[k] for k in some])
                        open_.docs += docs[r : r + fit]
                        r += fit
                        continue
                    if open_.held:
                        yield open_.shard(arrow)
                        open_ = _Open()
                        continue
                    # A row longer than a shard: pieces that overlap, its last one in an open shard.
                    at, end, begin = 0, int(lengths[r]), int(held.rows[r])
                    while end - at > most - 1:
                        open_.add(flat.slice(begin + at, most - 1), np.array([most - 1]), [ids[r]], at)
                        yield open_.shard(arrow)
                        open_, at = _Open(), at + most - size
                    open_.add(flat.slice(begin + at, end - at), np.array([end - at]), [ids[r]], at)
                    open_.docs.append(docs[r])
                    r += 1
        if open_.docs:
            yield open_.shard(arrow)

    return stored(in_arrow(rows, run, schema), "fm-index")


# --- Items ---------------------------------------------------------------------------------------


@dataclass
class Block:
    """Some items' distinct windows, as rows of numbered words, and the items that have each."""

    vocabulary: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    items: np.ndarray
    names: list[str | None]


def block_of(pieces: list[tuple[str | None, list[bytes]]], size: int) -> Block:
    """``pieces`` are runs of words of an item; those of one item overlap by ``size - 1`` words."""
    words: dict[bytes, int] = {}
    names: dict[str | None, int] = {}
    seen: dict[tuple[int, ...], set[int]] = {}
    for name, found in pieces:
        item = names.setdefault(name, len(names))
        numbers = [words.setdefault(w, len(words)) for w in found]
        for i in range(max(1, len(numbers) - size + 1)):
            seen.setdefault(tuple(numbers[i : i + size]), set()).add(item)
    windows = np.full((len(seen), size), -1, np.int64)
    for k, window in enumerate(seen):
        windows[k, : len(window)] = window
    counts = np.array([len(v) for v in seen.values()], np.int64)
    items = np.array([x for v in seen.values() for x in sorted(v)], np.int64)
    return Block(
        pa.array(list(words), pa.binary()), windows, (windows >= 0).sum(axis=1), np.append(0, np.cumsum(counts)), items,
        list(names),
    )


def item_blocks(items: DataFrame, size: int, id_column: str, text_column: str) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK`` bytes, read one at a time."""
    fold = F.translate(text_or_empty(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(fold, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    words = items.select(F.col(id_column).cast("string").alias("item"), found.alias("words")).where(F.size("words") > 0)
    # Long items are cut into overlapping pieces, so that a block's size is that of many small rows.
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(PIECE))
    cut = words.select("item", "words", F.explode(starts).alias("at")).select(
        "item", F.slice("words", F.col("at") + 1, PIECE + size - 1).alias("words")
    )
    cut = stored(cut, "items")
    total = cut.agg(F.sum(F.length(F.concat_ws(" ", "words")))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    for k in range(blocks):
        mine = cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else cut
        rows = [(r.item, [w.encode() for w in r.words]) for r in mine.collect()]
        if rows:
            yield block_of(rows, size)


# --- Search --------------------------------------------------------------------------------------

HITS = "row_id long, spans array<struct<begin:long,end:long>>, items array<string>"


def _hits(row: dict, block: Block) -> pa.RecordBatch | None:
    lengths = np.frombuffer(row["lengths"], np.int32)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    vocabulary = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(row["vocabulary"])]
    )
    if not row["n"]:
        return None
    known = pc.index_in(block.vocabulary.cast(pa.large_binary()), value_set=vocabulary)
    numbers = pc.fill_null(known, -1).to_numpy().astype(np.int32) + 1
    windows = np.where(block.windows >= 0, numbers[block.windows], -1)
    possible = np.flatnonzero(~(windows == 0).any(axis=1))
    if not len(possible):
        return None
    index = Index.read(row)
    alive, low, high = index.search(windows[possible].astype(np.int32))
    if not len(alive):
        return None
    begins = np.frombuffer(row["begins"], np.int32).astype(np.int64)
    firsts = np.frombuffer(row["firsts"], np.int64)
    found, counts = possible[alive], (high - low).astype(np.int64)
    change = np.zeros(index.n + 1, np.int32)
    pairs = np.zeros(0, np.int64)
    whole = np.cumsum(counts)
    for at in range(0, int(whole[-1]), CHUNK):
        which = np.arange(at, min(at + CHUNK, int(whole[-1])))
        k = np.searchsorted(whole, which, side="right")
        places = index.locate(low[k] + which - (whole[k] - counts[k]))
        window = found[k]
        np.add.at(change, places, 1)
        np.add.at(change, places + block.lengths[window], -1)
        piece = np.searchsorted(begins, places, side="right") - 1
        # The items of every window found, once for each row.
        mine = np.unique(piece * len(block.lengths) + window)
        piece, window = mine // len(block.lengths), mine % len(block.lengths)
        many = block.at[window + 1] - block.at[window]
        item = block.items[wd.spread(block.at[window], many)]
        pairs = np.union1d(pairs, np.repeat(piece, many) * len(block.names) + item)
    inside = np.append(0, (np.cumsum(change[:-1]) > 0).astype(np.int8))
    edges = np.diff(np.append(inside, 0))
    span_begin, span_end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    # A row's end mark is in no window, so a span lies in one row.
    owner = np.searchsorted(begins, span_begin, side="right") - 1
    pieces = np.unique(owner)
    shift = firsts[owner] - begins[owner]
    spans = pa.StructArray.from_arrays([pa.array(span_begin + shift), pa.array(span_end + shift)], names=["begin", "end"])
    names = pa.array(block.names, pa.string()).take(pa.array(pairs % len(block.names)))
    row_ids = pa.array([row["row_ids"][k] for k in pieces], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            row_ids,
            pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owner, pieces), len(owner)).astype(np.int32)), spans),
            pa.ListArray.from_arrays(
                pa.array(np.append(np.searchsorted(pairs // len(block.names), pieces), len(pairs)).astype(np.int32)), names
            ),
        ],
        names=["row_id", "spans", "items"],
    )


def find(index: DataFrame, items: DataFrame, size: int = SIZE, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(row_id, spans, items) of the indexed rows with windows of ``items``; spans are of words, merged."""
    found = None
    for block in item_blocks(items, size, id_column, text_column):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    hits = _hits(row, block)
                    if hits is not None:
                        yield hits

        part = stored(in_arrow(index, run, HITS), "hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return index.sparkSession.createDataFrame([], HITS)
    gathered = found.groupBy("row_id").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.array().cast("array<struct<begin:long,end:long>>")

    def merge(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["begin"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    # Only rows in several pieces, or found in several blocks, have spans left to merge.
    touching = F.exists(
        F.sequence(F.lit(1), F.size("spans") - 1),
        lambda i: F.get("spans", i - 1)["end"] >= F.get("spans", i)["begin"],
    )
    several = F.when(F.size("spans") > 1, touching).otherwise(False)
    return gathered.withColumn("spans", F.when(several, F.aggregate("spans", start, merge)).otherwise(F.col("spans")))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = SIZE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (runs of words found, merged), items (ids, as text)."""
    index = build_index(docs, size, id_column=id_column, text_column=text_column)
    rows = index.select(F.inline("docs"))
    found = find(index, items, size, item_id_column, item_text_column)
    none = F.array().cast("array<struct<begin:long,end:long>>")
    return rows.join(found, "row_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
