"""Removal of repeated byte strings by comparing windows bucket by bucket.

Every byte covered by a string of ``size`` bytes that also starts earlier (in a smaller ``doc_id``,
or in the same document further left) is removed. Whether a string repeats is judged on the input.

Suffixes are not dealt by their leading tokens, and no total suffix order is made. A window of 100
bytes is grouped by its anchor of ``repeats``: the 32-byte gram in it whose hash is least, wherever it
stands, which equal windows share. Spark samples splitters and deals runs of windows by range of
(anchor's hash, document, place); a bucket splits its windows by their bytes, eight at a time, and
windows that agree over the whole length are repeats; windows of an anchor that lies in several
buckets are compared across them by their bytes.

The split works on whole arrays, as a multikey quicksort does: at every depth the windows that are
still tied are split by their next eight bytes, and those that stand alone drop out (see
``repeats.refine``).

Defined cases. Null text counts as empty. Texts shorter than ``size`` lose nothing. A null
``doc_id`` is larger than any other. Rows that repeat ``doc_id`` are ordered by a hash of their
text; rows that repeat both are one place in the order, so neither is removed for the other. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from convoy.llm import repeats

SIZE, GRAM = 100, 32


def multikey(
    tokens: repeats.Tokens, groups: np.ndarray, starts: np.ndarray, lengths: np.ndarray, _: np.ndarray
) -> np.ndarray:
    """Classes of equal strings: each group is sorted from the left, one 64-bit value at a time."""
    depth = tokens.depth(int(lengths.max(initial=0)))
    return repeats.refine(groups, lambda i, d: tokens.value(starts[i], lengths[i], d), depth)


def remove_repeats(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens (bytes), removed (begin and end of runs), kept (bytes).

    ``gram`` is a power of two below ``size``.
    """
    return repeats.without_repeats(docs, repeats.byte_tokens, multikey, size, gram, id_column, text_column)
