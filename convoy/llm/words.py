"""The words of many texts at once, as one flat buffer with exact numbers for equal words.

A class of bytes says what is part of a word. Texts are UTF-8, where every byte of a character
above U+007F is 0x80 or more, so classes of such characters are classes of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Words between ASCII white space, unchanged.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Words of letters, digits and characters above U+007F.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """The words of some rows, one after the other.

    ``text`` holds them without anything between; word i is ``text[at[i] : at[i + 1]]`` and row r
    has words ``rows[r]`` to ``rows[r + 1]``.
    """

    text: np.ndarray
    at: np.ndarray
    rows: np.ndarray

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """A number per word, equal for equal bytes only, and the words that the numbers stand for."""
        flat = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(self.at), pa.py_buffer(self.text)]
        )
        coded = flat.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def joined(self, which: np.ndarray, owner: np.ndarray, n_rows: int) -> pa.Array:
        """Words ``which``, row after row by ``owner``, each row's joined by one space, as one text per row."""
        lengths = self.at[which + 1] - self.at[which] + 1
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        begins = ends - lengths
        letters = spread(begins, lengths - 1)
        out[letters] = self.text[letters + np.repeat(self.at[which] - begins, lengths - 1)]
        # The space after a row's last word goes.
        counts = np.bincount(owner, minlength=n_rows)
        last = np.cumsum(counts)[counts > 0] - 1
        keep = np.ones(len(out), dtype=bool)
        keep[ends[last] - 1] = False
        sizes = np.bincount(owner, weights=lengths, minlength=n_rows).astype(np.int64) - (counts > 0)
        offsets = np.append(0, np.cumsum(sizes))
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out[keep])]
        )


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every run."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(begins - first, lengths) + np.arange(total)


def split(flat: np.ndarray, offsets: np.ndarray, part: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """The words of the rows whose bytes are ``flat[offsets[r] : offsets[r + 1]]``."""
    inside = np.zeros(len(flat) + 1, dtype=bool)
    inside[:-1] = part[flat]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    # A row's first byte begins a word even if the row before ends in one.
    firsts = offsets[:-1][offsets[:-1] < len(flat)]
    starts[firsts] = inside[firsts]
    text = flat[inside[:-1]]
    if fold is not None:
        text = fold[text]
    begins = np.flatnonzero(starts)
    # Where the words begin once all other bytes are gone.
    gone = np.flatnonzero(starts[inside[:-1]])
    at = np.append(gone, len(text)).astype(np.int64)
    return Words(np.ascontiguousarray(text), at, np.searchsorted(begins, offsets).astype(np.int64))
