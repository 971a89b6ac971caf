"""Periodic runs of words, found with a suffix automaton and link-cut access.

A run is a stretch of consecutive words in which words ``q`` apart are equal (``q`` the smallest
such period), at least ``max(min_length, 2 q)`` words long, that no neighbouring word extends.

Method. Words are appended one by one to a suffix automaton whose tree of suffix links is held as a
link-cut tree. Every state carries the end of its strings' last occurrence; states with one such
end form a path segment. Appending a word accesses the new prefix: the segments on its way to the
root tell, each by its deepest state, how long a suffix ended where last, and the whole way is then
recoloured with the new end. If the distance between the previous and the new end is within the
segment's length, a square has been read; it is extended both ways to its run, once for each.

Before that, exactly and for whole batches:

1. A run holds a gram of ``min_length / 2`` words that stands twice, ``q`` words apart, and all its
   words are inside such grams. So only stretches covered by grams that repeat go to the automaton;
   a 64-bit code picks them (two grams of one code cost time only), exact numbers decide.
2. What is appended are grams. A gram that always has the same next one, which always has that
   gram before it, is merged with it into one symbol whose weight is its number of grams. Where a run
   ends or begins, its grams differ in their neighbour, so runs begin and end between symbols; a
   periodic text of long period shrinks to a few symbols for each repetition.

A document is one row and is worked on by itself, so nothing is shuffled and no group can be hot.

Defined cases. Null text has no words and no runs. Texts shorter than ``min_length`` words have
none. Rows that repeat an id are separate rows. An empty table gives no rows. Very long texts are
held as a few arrays of their number of words. Columns of the input other than the two named are
not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm import words as wd
from convoy.llm.common import buffers, in_arrow, slices, text_or_empty

MIN_LENGTH = 12
SLICE = 2 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class LinkCutAutomaton:
    """A suffix automaton of weighted symbols; its suffix links form a link-cut tree.

    ``append`` returns, for every path segment on the new prefix's way to the root, the end of its
    previous occurrence and the weight of its longest string. State 0 is the root and has no segment.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        # The weight of the state's longest string.
        self.weight = [0]
        self.last = 0
        # Splay trees over the paths: left is towards the root, up also leads from path to path.
        self.left, self.right, self.up = [-1], [-1], [-1]
        self.seen, self.owed = [0], [0]
        self.ends = [0]

    def _state(self, after: dict[int, int], length: int, weight: int, seen: int) -> int:
        self.next.append(after)
        self.link.append(-1)
        self.length.append(length)
        self.weight.append(weight)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(-1)
        self.seen.append(seen)
        self.owed.append(0)
        return len(self.next) - 1

    def _pay(self, x: int) -> None:
        """Pass a new end on to the two subtrees of ``x``."""
        owed = self.owed[x]
        if owed:
            for child in (self.left[x], self.right[x]):
                if child >= 0:
                    self.seen[child] = self.owed[child] = owed
            self.owed[x] = 0

    def _top(self, x: int) -> bool:
        above = self.up[x]
        return above < 0 or (self.left[above] != x and self.right[above] != x)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        above = up[x]
        higher = up[above]
        if higher >= 0:
            if left[higher] == above:
                left[higher] = x
            elif right[higher] == above:
                right[higher] = x
        if left[above] == x:
            moved = left[above] = right[x]
            right[x] = above
        else:
            moved = right[above] = left[x]
            left[x] = above
        if moved >= 0:
            up[moved] = above
        up[above], up[x] = x, higher

    def _splay(self, x: int) -> None:
        way = [x]
        while not self._top(way[-1]):
            way.append(self.up[way[-1]])
        for y in reversed(way):
            self._pay(y)
        while not self._top(x):
            above = self.up[x]
            if not self._top(above):
                same = (self.left[above] == x) == (self.left[self.up[above]] == above)
                self._rotate(above if same else x)
            self._rotate(x)

    def append(self, symbol: int, weight: int) -> list[tuple[int, int]]:
        end = self.ends[-1] + weight
        self.ends.append(end)
        n = len(self.ends) - 1
        new = self._state({}, n, end, 0)
        p = self.last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p < 0:
            above = 0
        else:
            q = self.next[p][symbol]
            if self.length[q] == self.length[p] + 1:
                above = q
            else:
                # The strings of q that are too long stay; the clone takes the rest and q's last end.
                above = self._state(dict(self.next[q]), self.length[p] + 1, self.weight[p] + weight, 0)
                self._insert(above, q)
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = above
                    p = self.link[p]
        self.link[new] = self.up[new] = above
        self.last = new
        return self._recolour(above, new, end)

    def _insert(self, x: int, q: int) -> None:
        """Put ``x`` between ``q`` and its parent, on the path of ``q`` and with its last end."""
        self._splay(q)
        self.left[x] = self.left[q]
        if self.left[q] >= 0:
            self.up[self.left[q]] = x
        self.left[q], self.up[x] = x, q
        self.seen[x] = self.seen[q]
        self.link[x], self.link[q] = self.link[q], x

    def _recolour(self, at: int, new: int, end: int) -> list[tuple[int, int]]:
        """Access ``new``, whose parent is ``at``: all of its way to the root becomes one path of one end."""
        found, below = [], new
        while at >= 0:
            self._splay(at)
            if at:
                found.append((self.seen[at], self.weight[at]))
            self.right[at] = below
            below, at = at, self.up[at]
        self._splay(new)
        self.seen[new] = self.owed[new] = end
        return found


def runs_of(numbers: np.ndarray, symbols: list[int], weights: list[int], gram: int, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch; ``symbols`` are its merged grams."""
    automaton = LinkCutAutomaton()
    breaks: dict[int, list[int]] = {}
    found: set[tuple[int, int, int]] = set()
    covered: dict[int, int] = {}
    n = len(numbers)
    for symbol, weight in zip(symbols, weights, strict=True):
        for before, reach in automaton.append(symbol, weight):
            end = automaton.ends[-1]
            q = end - before
            # In words a match is longer than in grams by all but one word of the last gram.
            if reach + gram - 1 < q or covered.get(q, -1) >= end:
                continue
            if q not in breaks:
                breaks[q] = np.flatnonzero(numbers[q:] != numbers[:-q]).tolist()
            # Words j and j + q agree from just after one break to just before the next.
            k = bisect_left(breaks[q], before - 1)
            start = breaks[q][k - 1] + 1 if k else 0
            stop = (breaks[q][k] if k < len(breaks[q]) else n - q) + q
            covered[q] = stop - gram + 1
            if stop - start >= max(min_length, 2 * q):
                found.add((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _grams(numbers: np.ndarray, gram: int) -> np.ndarray:
    """An exact number for every run of ``gram`` words, by pairs of shorter ones."""
    out, span = _dense(numbers), 1
    while span < gram:
        step = min(span, gram - span)
        size = int(out.max(initial=0)) + 1
        out = _dense(out[: len(out) - step] * size + out[step:])
        span += step
    return out


def _repeated(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a code stands at least twice in its row, as far as 64 bits can tell."""
    with np.errstate(over="ignore"):
        keyed = (codes + row.astype(np.uint64) * _MUL) * _MIX
        keyed ^= keyed >> np.uint64(29)
    ordered = np.sort(keyed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(codes), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keyed), len(twice) - 1)
    return twice[at] == keyed


def _codes(numbers: np.ndarray, gram: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        out = np.zeros(len(numbers) - gram + 1, np.uint64)
        for j in range(gram):
            out = out * _MUL + mixed[j : j + len(out)]
    return out


def _covered(starts: np.ndarray, gram: int, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + gram, -1)
    return np.cumsum(change[:-1]) > 0


def _stretches(numbers: np.ndarray, rows: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches of words, inside one row each, that may hold runs."""
    n = len(numbers)
    if n < gram:
        return []
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    starts = np.flatnonzero(owner[gram - 1 :] == owner[: n - gram + 1])
    codes = _codes(numbers, gram)
    group = owner
    for _ in range(2):
        # First grams that repeat in their row, then those that do so in their stretch.
        starts = starts[_repeated(codes[starts], group[starts])]
        if not len(starts):
            return []
        inside = _covered(starts, gram, n)
        edge = np.append(True, (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1]))
        group = np.cumsum(edge) - 1
    heads = np.flatnonzero(edge)
    tails = np.append(heads[1:], n)
    return [(int(a), int(b)) for a, b in zip(heads[inside[heads]], tails[inside[heads]], strict=True)]


def find_runs(numbers: np.ndarray, rows: np.ndarray, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Per row the runs (start, length, period) of its words, by start and then period."""
    gram = -(-min_length // 2)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(rows) - 1)]
    for a, b in _stretches(numbers, rows, gram):
        if b - a < min_length:
            continue
        part = numbers[a:b]
        grams = _grams(part, gram)
        if int(grams.max()) + 1 == len(grams):
            continue
        symbols, weights = _merged(grams)
        row = int(np.searchsorted(rows, a, side="right")) - 1
        shift = a - int(rows[row])
        out[row] += [(s + shift, n, q) for s, n, q in runs_of(part, symbols, weights, gram, min_length)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _merged(grams: np.ndarray) -> tuple[list[int], list[int]]:
    """Grams that always follow one another as one symbol: the symbols and their weights."""
    n = len(grams)
    after, before = np.append(grams[1:], -1), np.append(-1, grams[:-1])
    first = np.unique(grams, return_index=True)[1]
    loose_after, loose_before = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
    loose_after[grams[after != after[first[grams]]]] = True
    loose_before[grams[before != before[first[grams]]]] = True
    edge = np.append(True, loose_after[grams[:-1]] | loose_before[grams[1:]])
    heads = np.flatnonzero(edge)
    return grams[heads].tolist(), np.diff(np.append(heads, n)).tolist()


def _left(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: all but those of a run after its first period."""
    change = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def collapse(
    docs: DataFrame, min_length: int = MIN_LENGTH, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period), collapsed.

    ``collapsed`` is the text without the words of a run after its first period, joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield _collapse(batch, min_length)

    texts = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        texts, run,
        f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )


def _collapse(batch: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    held = wd.split(*buffers(batch.column("text")), wd.NOT_SPACE)
    rows, n_rows = held.rows, batch.num_rows
    found = find_runs(held.numbered()[0], rows, min_length)
    counts = np.array([len(r) for r in found])
    which = np.arange(len(held.at) - 1)
    if counts.any():
        keep = np.ones(len(which), dtype=bool)
        for r in np.flatnonzero(counts):
            mine = keep[rows[r] : rows[r + 1]]
            mine[:] = False
            mine[_left(len(mine), found[r])] = True
        which = which[keep]
    owner = np.searchsorted(rows, which, side="right") - 1
    flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(np.diff(rows)),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans),
            held.joined(which, owner, n_rows).cast(pa.large_string()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def repeat_tails(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the tails of one in ten texts made periodic, by a checksum of the id.

    With h the CRC-32 of the id and g = h div 10, texts of h % 10 = 0 repeat, from word a = g % n on,
    the next p = 1 + (n - a) div (3 + g % 8) words. An id that is null changes nothing.
    """
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    all_words = F.regexp_extract_all(text_or_empty(text_column), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.floor(h / 10).cast("long").alias("g"),
        F.when(h % 10 == 0, all_words).alias("words"),
    )
    n = F.greatest(F.size("words"), F.lit(1)).cast("long")
    a = F.col("g") % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8)).cast("long")
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
    tail = F.array_join(F.transform(place, lambda i: F.get(F.col("words"), i.cast("int"))), " ")
    made = F.when(F.coalesce(F.size("words") > 0, F.lit(False)), tail).otherwise(F.col("row").getField(text_column))
    return chosen.select(F.col("row").withField(f"`{text_column}`", made).alias("row")).select("row.*")
