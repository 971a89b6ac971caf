"""Repeated windows of tokens across a corpus: what suffix-array and seed-and-extend dedup share.

A window is ``size`` consecutive tokens of one document; the task is to find every window whose
sequence also starts earlier. Shipping every window is out of reach (a corpus of n bytes has n
windows of 100 bytes), so windows are grouped by an anchor first: the gram of ``gram`` tokens in
the window that is least under a hash, the last one among equals. The choice depends on the window
alone, so equal windows have equal anchors at equal places, and windows that follow one another
mostly share theirs. Such a run of windows is a segment, about (size - gram) / 2 windows long.

1. Anchors' hashes are counted over the corpus; only those met twice can hold a repeat.
2. Segments on such anchors are cut out with their text (what repeats within one document is
   settled on the spot, so periodic text does not multiply).
3. Segments with one anchor meet and are compared token by token, by an operator's own order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import buffers, in_arrow, slices, stored, text_or_empty

SLICE = 2 << 20
CHUNK = 1 << 20
LAST = (1 << 63) - 1
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW32 = np.uint64(0xFFFFFFFF)
# Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
# One random odd code for every byte value, the same on all machines.
BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass
class Tokens:
    """The tokens of some rows: a flat text, the rows' token offsets, and the tokens' places in the text."""

    text: np.ndarray
    rows: np.ndarray
    codes: Callable[[int, int], np.ndarray]
    begin: Callable[[np.ndarray], np.ndarray]
    end: Callable[[np.ndarray], np.ndarray]
    # How many tokens at a place one 64-bit value can hold, and those values.
    packed: int
    values: np.ndarray
    # Bytes that stand between two tokens.
    gap: int = 0

    def row_begin(self) -> np.ndarray:
        """Where the rows begin in the text; one more than there are rows."""
        whole = np.append(self.begin(np.arange(int(self.rows[-1]))), len(self.text))
        return whole[self.rows]

    def value(self, starts: np.ndarray, length: np.ndarray | int, d: int) -> np.ndarray:
        """The d-th 64-bit value of the runs of ``length`` tokens; the last ones repeat rather than run over."""
        last = np.maximum(length - self.packed, 0)
        return self.values[starts + np.minimum(d * self.packed, last)]

    def depth(self, length: int) -> int:
        return -(-length // self.packed)


def byte_tokens(flat: np.ndarray, offsets: np.ndarray, size: int = 8) -> Tokens:
    if size < 8:
        return Tokens(flat, offsets, lambda a, b: BYTE_CODES[flat[a:b]], lambda t: t, lambda t: t + 1, 1, flat)
    padded = np.append(flat, np.zeros(8, np.uint8))
    eight = np.ndarray(len(flat) + 1, dtype=">u8", buffer=padded.data, strides=(1,))
    return Tokens(flat, offsets, lambda a, b: BYTE_CODES[flat[a:b]], lambda t: t, lambda t: t + 1, 8, eight)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_tokens(flat: np.ndarray, offsets: np.ndarray, size: int = 1) -> Tokens:
    """Words between ASCII white space; the text holds them with one space after each."""
    # A space after every row ends its last word.
    flat = np.insert(flat, offsets[1:], np.uint8(0x20)) if len(offsets) > 1 else flat
    offsets = offsets + np.arange(len(offsets))
    space = _IS_SPACE[flat]
    after_word = np.append(False, ~space[:-1]) if len(flat) else space
    starts = np.flatnonzero(~space & ~after_word)
    text = np.where(space, np.uint8(0x20), flat)[~space | after_word]
    ends = np.flatnonzero(text == 0x20) + 1
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    rows = np.searchsorted(starts, offsets)
    codes = WordCodes(text, begins, ends - begins - 1)
    return Tokens(text, rows, lambda a, b: codes[a:b], lambda t: begins[t], lambda t: ends[t] - 1, 1, codes, 1)


class WordCodes:
    """The words' codes, worked out when the first one is asked for."""

    def __init__(self, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        self.words, self.codes = (text, begins, lengths), None

    def __getitem__(self, which: slice | np.ndarray) -> np.ndarray:
        if self.codes is None:
            self.codes = word_codes(*self.words)
        return self.codes[which]


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(begins - first, lengths) + np.arange(total)


def word_codes(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit code per word: Horner's rule over its runs of eight bytes, for all words at once."""
    padded = np.append(text, np.zeros(8, np.uint8))
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    out = lengths.astype(np.uint64) * _MUL
    left, done = np.arange(len(begins)), 0
    while len(left):
        rest = np.minimum(lengths[left] - done, 8)
        run = eight[begins[left] + done] & _FIRST_BYTES[rest]
        mixed = (out[left] ^ run) * _MIX
        out[left] = (mixed ^ (mixed >> np.uint64(31))) * _MUL
        done += 8
        left = left[lengths[left] > done]
    return (out ^ (out >> np.uint64(29))) * _MIX


def gram_codes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit code for every run of ``gram`` tokens; ``gram`` is a power of two."""
    out, span, factor = codes, 1, _MUL
    while span < gram:
        out = out[:-span] * factor + out[span:]
        factor = factor * factor
        span *= 2
    return (out ^ (out >> np.uint64(31))) * _MIX


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    out = values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


@dataclass
class Segments:
    """Runs of window starts with one anchor; all numbers are places in the flat token stream."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    code: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        return Segments(*(getattr(self, n)[which] for n in ("row", "first", "last", "anchor", "code")))


def segments(tokens: Tokens, size: int, gram: int) -> Segments:
    parts: list[tuple[np.ndarray, ...]] = []
    total, rows = int(tokens.rows[-1]), tokens.rows
    lengths = np.diff(rows)
    with np.errstate(over="ignore"):
        for at in range(0, max(0, total - size + 1), CHUNK):
            stop = min(total, at + CHUNK + size - 1)
            n = stop - at - size + 1
            codes = gram_codes(tokens.codes(at, stop), gram)
            places = np.arange(len(codes), dtype=np.uint64)
            least = _sliding_min((codes & ~_LOW32) | (_LOW32 - places), size - gram + 1)
            anchor = (_LOW32 - (least & _LOW32)).astype(np.int64)
            # Windows that run over the end of their row do not count.
            change = np.zeros(n + 1, np.int64)
            begins = np.clip(rows[:-1] - at, 0, n)
            ends = np.clip(rows[1:] - size + 1 - at, 0, n)
            some = (lengths >= size) & (ends > begins)
            np.add.at(change, begins[some], 1)
            np.add.at(change, ends[some], -1)
            starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            if not len(starts):
                continue
            anchor = anchor[starts]
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(starts)) - 1
            parts.append((starts[head] + at, starts[tail] + at, anchor[head] + at, codes[anchor[head]].view(np.int64)))
    if not parts:
        empty = np.zeros(0, np.int64)
        return Segments(empty, empty, empty, empty, empty)
    first, last, anchor, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Segments(np.searchsorted(rows, first, side="right") - 1, first, last, anchor, code)


def refine(groups: np.ndarray, fetch: Callable[[np.ndarray, int], np.ndarray], depth: int) -> np.ndarray:
    """Class numbers of items: equal for items of one group whose values agree at every depth.

    A multikey sort over whole arrays: at each depth a group is split by its next value, and items
    that stand alone drop out. Groups in which all values agree are left as they stand, unsorted.
    """
    classes = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    fresh = len(groups)
    live = np.argsort(classes, kind="stable")
    live = live[np.bincount(classes)[classes[live]] > 1] if len(live) else live
    for d in range(depth):
        if not len(live):
            break
        group, value = classes[live], fetch(live, d)
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        counts = np.diff(np.append(head, len(live)))
        differs = value != np.repeat(value[head], counts)
        split = np.repeat(np.add.reduceat(differs, head) > 0, counts)
        if not split.any():
            continue
        rest, part = live[~split], live[split]
        group, value = group[split], value[split]
        order = np.lexsort((value, group))
        part, group, value = part[order], group[order], value[order]
        new = np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))
        number = np.cumsum(new) - 1
        classes[part] = fresh + number
        fresh += int(number[-1]) + 1
        live = np.concatenate([rest, part[np.bincount(number)[number] > 1]])
    return classes


def not_least(classes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether an item of lower rank is in an item's class; ranks may tie."""
    order = np.lexsort((rank, classes))
    sorted_classes = classes[order]
    head = np.append(True, sorted_classes[1:] != sorted_classes[:-1]) if len(order) else np.zeros(0, bool)
    least = rank[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.zeros(len(order), dtype=bool)
    out[order] = rank[order] > least
    return out


def windows_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window start of the segments, and the number of the segment it belongs to."""
    lengths = last - first + 1
    return _spread(first, lengths), np.repeat(np.arange(len(first)), lengths)


def runs(owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one owner as (owner, first, last); both inputs ordered."""
    if not len(starts):
        return owner, starts, starts
    new = np.append(True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1))
    head = np.flatnonzero(new)
    return owner[head], starts[head], starts[np.append(head[1:], len(starts)) - 1]


def grouped(*keys: np.ndarray) -> np.ndarray:
    """One dense number per distinct combination of keys."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.int64)
    for key in keys[1:]:
        inverse = np.unique(key, return_inverse=True)[1].astype(np.int64)
        out = np.unique(out * (int(inverse.max(initial=0)) + 1) + inverse, return_inverse=True)[1].astype(np.int64)
    return out


# --- The corpus ---------------------------------------------------------------------------------

Tokenise = Callable[[np.ndarray, np.ndarray, int], Tokens]
SEGMENT = "code long, doc long, alt long, first long, last long, ahead int, piece binary"
RUN = "doc long, alt long, first long, last long, window binary"


def identity(id_column: str, text_column: str) -> list[Column]:
    """Two numbers that name a row: ``doc_id`` (null last) and, for rows that repeat it, a hash of the text."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text_or_empty(text_column)).alias("alt"),
    ]


def repeated_anchors(texts: DataFrame, tokenise: Tokenise, size: int, gram: int) -> DataFrame:
    """(doc, codes): the anchors of a document that the corpus holds more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = segments(tokenise(*buffers(batch.column("text")), size), size, gram)
                order = np.lexsort((found.code, found.row))
                row, code = found.row[order], found.code[order]
                same = np.zeros(len(row), dtype=bool)
                same[1:] = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
                third = same.copy()
                third[1:] &= same[:-1]
                # One met again in its own document is told twice, and that is enough.
                row, code = row[~third], code[~third]
                docs = batch.column("doc").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(docs[row])], names=["code", "doc"])

    anchors = stored(in_arrow(texts.select("doc", "text"), run, "code long, doc long"), "anchors")
    several = anchors.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    return anchors.join(several, "code", "left_semi").groupBy("doc").agg(F.collect_set("code").alias("codes"))


def cut_segments(texts: DataFrame, tokenise: Tokenise, size: int, gram: int) -> DataFrame:
    """The segments on repeated anchors, as rows of ``SEGMENT``.

    ``ahead`` is the anchor's distance from the first window's start, ``piece`` the text of all the
    segment's windows. Rows without a piece are runs of windows that repeat within their own document.
    """
    codes = repeated_anchors(texts, tokenise, size, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield _cut(batch, tokenise, size, gram)

    joined = texts.join(codes, "doc").select("doc", "alt", "text", "codes")
    return in_arrow(joined, run, SEGMENT)


def _pieces(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - begin
    flat = text[_spread(begin, lengths)]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _cut(batch: pa.RecordBatch, tokenise: Tokenise, size: int, gram: int) -> pa.RecordBatch:
    tokens = tokenise(*buffers(batch.column("text")), size)
    wanted = batch.column("codes").flatten().to_numpy(zero_copy_only=False)
    found = segments(tokens, size, gram)
    found = found.take(np.isin(found.code, wanted))
    # Windows that repeat within their row: only anchors met again in the row can hold them.
    again = np.zeros(0, np.int64)
    if len(found.row):
        key = grouped(found.row, found.code)
        again = np.flatnonzero(np.bincount(key)[key] > 1)
    starts, owner = windows_of(found.first[again], found.last[again])
    owner = again[owner]
    gone = np.zeros(len(starts), dtype=bool)
    if len(starts):
        group = grouped(found.row[owner], found.code[owner], found.anchor[owner] - starts)
        classes = refine(group, lambda i, d: tokens.value(starts[i], size, d), tokens.depth(size))
        gone = not_least(classes, starts)
    alone = np.ones(len(found.row), dtype=bool)
    alone[again] = False
    kept_owner, kept_first, kept_last = runs(owner[~gone], starts[~gone])
    gone_owner, gone_first, gone_last = runs(owner[gone], starts[gone])
    kept = np.concatenate([np.flatnonzero(alone), kept_owner])
    first = np.concatenate([found.first[alone], kept_first])
    last = np.concatenate([found.last[alone], kept_last])
    piece = _pieces(tokens.text, tokens.begin(first), tokens.end(last + size - 1))
    every = np.concatenate([kept, gone_owner])
    row = found.row[every]
    all_first, all_last = np.concatenate([first, gone_first]), np.concatenate([last, gone_last])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found.code[every]),
            pa.array(batch.column("doc").to_numpy()[row]),
            pa.array(batch.column("alt").to_numpy()[row]),
            pa.array(all_first - tokens.rows[row]),
            pa.array(all_last - tokens.rows[row]),
            pa.array((found.anchor[every] - all_first).astype(np.int32)),
            pa.concat_arrays([piece, pa.nulls(len(gone_owner), pa.binary())]),
        ],
        names=["code", "doc", "alt", "first", "last", "ahead", "piece"],
    )


def ordered_rank(*keys: np.ndarray) -> np.ndarray:
    """The rank of every item by ``keys``, the first one leading; equal items have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


Compare = Callable[[Tokens, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def compare_bucket(bucket: pa.Table, tokenise: Tokenise, compare: Compare, size: int) -> pa.RecordBatch:
    """Rows of ``RUN`` for a bucket that holds whole anchors, but for its first and last.

    Equal segments are told apart from the rest first, so that of a group of copies one is left.
    Windows of what is left are compared within their anchor. Runs of repeats come without a
    window; a window of the first or last anchor that is new here may repeat one of another bucket
    and comes with its text.
    """
    code, doc, alt = (bucket.column(n).to_numpy() for n in ("code", "doc", "alt"))
    first, last = bucket.column("first").to_numpy(), bucket.column("last").to_numpy()
    ahead = bucket.column("ahead").to_numpy().astype(np.int64)
    tokens = tokenise(*buffers(bucket.column("piece")), size)
    base, count = tokens.rows[:-1], last - first + 1
    rank = ordered_rank(doc, alt, first)
    length = count + size - 1
    same = grouped(code, ahead, count)
    classes = compare(tokens, same, base, length, ahead)
    copy = not_least(classes, rank)
    rest = np.flatnonzero(~copy)
    key = grouped(code[rest])
    edge = (code[rest] == code.min()) | (code[rest] == code.max())
    rest = rest[(np.bincount(key)[key] > 1) | edge]
    starts, owner = windows_of(base[rest], base[rest] + count[rest] - 1)
    owner = rest[owner]
    place = ahead[owner] - (starts - base[owner])
    group = grouped(code[owner], place)
    classes = compare(tokens, group, starts, np.full(len(starts), size), place)
    gone = not_least(classes, rank[owner])
    gone_owner, gone_first, gone_last = runs(owner[gone], starts[gone])
    open_ = np.flatnonzero(~gone & ((code[owner] == code.min()) | (code[owner] == code.max())))
    copies = np.flatnonzero(copy)
    who = np.concatenate([copies, gone_owner, owner[open_]])
    begin = np.concatenate([first[copies], first[gone_owner] + gone_first - base[gone_owner],
                            first[owner[open_]] + starts[open_] - base[owner[open_]]])
    end = np.concatenate([last[copies], first[gone_owner] + gone_last - base[gone_owner],
                          first[owner[open_]] + starts[open_] - base[owner[open_]]])
    text = _pieces(tokens.text, tokens.begin(starts[open_]), tokens.end(starts[open_] + size - 1))
    window = pa.concat_arrays([pa.nulls(len(copies) + len(gone_owner), pa.binary()), text])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[who]), pa.array(alt[who]), pa.array(begin), pa.array(end), window],
        names=["doc", "alt", "first", "last", "window"],
    )


def repeated_runs(texts: DataFrame, tokenise: Tokenise, compare: Compare, size: int, gram: int) -> DataFrame:
    """(doc, alt, runs): per document the runs (first, last) of starts of windows that also start earlier.

    Buckets are ranges of (anchor, document, place), cut at sampled splitters, so that an anchor
    that much of the corpus shares is dealt over several buckets by document. ``texts`` has doc,
    alt and text (binary).
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(cut_segments(texts, tokenise, size, gram), "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield compare_bucket(pa.Table.from_batches(held), tokenise, compare, size)

    dealt = cut.where("piece is not null").repartitionByRange(parts, "code", "doc", "alt", "first")
    compared = stored(in_arrow(dealt, run, RUN), "runs")
    settled = cut.where("piece is null").select("doc", "alt", "first", "last")
    # Across boundaries: the same window in several buckets.
    open_ = compared.where("window is not null").withColumn("at", F.struct("doc", "alt", "first"))
    firsts = open_.groupBy("window").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1")
    later = open_.join(firsts.select("window", "least"), "window").where("at > least")
    every = (
        compared.where("window is null")
        .select("doc", "alt", "first", "last")
        .unionByName(settled)
        .unionByName(later.select("doc", "alt", "first", "last"))
    )
    return every.groupBy("doc", "alt").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def covered(runs_: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of tokens that the windows starting in ``runs_`` cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs_[:, 0], 1)
    np.add.at(change, runs_[:, 1] + size, -1)
    inside = np.append(0, (np.cumsum(change) > 0).astype(np.int8))
    edges = np.diff(inside)
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)


def without_repeats(docs: DataFrame, tokenise: Tokenise, compare: Compare, size: int, gram: int, id_column: str,
                    text_column: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, removed (runs of tokens), kept (bytes of the rest)."""
    texts = docs.select(
        F.col(id_column).alias("doc_id"),
        *identity(id_column, text_column),
        text_or_empty(text_column).cast("binary").alias("text"),
    )
    found = repeated_runs(texts.select("doc", "alt", "text"), tokenise, compare, size, gram)
    schema = "doc_id long, n_tokens long, removed array<struct<begin:long,end:long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield _remove(batch, tokenise, size)

    id_type = dict(docs.dtypes)[id_column]
    joined = texts.join(found, ["doc", "alt"], "left").select(F.col("doc_id").cast("long"), "text", "runs")
    return in_arrow(joined, run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def _remove(batch: pa.RecordBatch, tokenise: Tokenise, size: int) -> pa.RecordBatch:
    tokens = tokenise(*buffers(batch.column("text")), size)
    rows, found = tokens.rows, batch.column("runs")
    offsets = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy()))
    flat = found.flatten()
    pairs = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1) if len(flat) else np.zeros((0, 2), int)
    owner = np.repeat(np.arange(len(found)), np.diff(offsets))
    begins, ends = covered(pairs + rows[owner][:, None], int(rows[-1]), size)
    # Runs of two documents that touch are cut at the border.
    inner = rows[1:-1][(rows[1:-1] > 0)]
    inner = inner[(np.searchsorted(begins, inner, side="left") > np.searchsorted(ends, inner, side="right"))]
    begins, ends = np.union1d(begins, inner), np.union1d(ends, inner)
    kept = np.ones(len(tokens.text) + 1, dtype=np.int8)
    if len(begins):
        change = np.zeros(len(tokens.text) + 1, np.int64)
        stop = tokens.end(ends - 1) + tokens.gap
        np.add.at(change, tokens.begin(begins), 1)
        np.add.at(change, stop, -1)
        kept = (np.cumsum(change) == 0).astype(np.int8)
    edges = np.append(0, np.cumsum(kept[: len(tokens.text)]))
    left = tokens.text[kept[: len(tokens.text)].astype(bool)]
    at = edges[tokens.row_begin()]
    pieces = _pieces(left, at[:-1], np.maximum(at[1:] - tokens.gap, at[:-1]))
    number = np.searchsorted(rows, begins, side="right") - 1
    counts = np.bincount(number, minlength=len(found)) if len(begins) else np.zeros(len(found), np.int64)
    spans = pa.StructArray.from_arrays(
        [pa.array(begins - rows[number]), pa.array(ends - rows[number])], names=["begin", "end"]
    )
    removed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), removed, pieces],
        names=["doc_id", "n_tokens", "removed", "kept"],
    )
