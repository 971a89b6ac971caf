"""Removal of repeated runs of words by seed and extend.

Every word covered by a window of ``size`` words that also starts earlier (in a smaller ``doc_id``,
or in the same document further left) is removed. Whether a window repeats is judged on the input.

Seeds are winnowed anchors (see ``repeats``): of every ``size`` consecutive words, the gram of
eight with the least hash. Documents are joined on them, and each seed is extended word by word, to
the right and then to the left, as long as another occurrence agrees; occurrences that agree
together stay together, so a group of copies is extended once and never paired off. What agrees
over ``size`` words or more is a repeat, and adjoining ones make up the maximal repeats that are
removed.

Words are compared by 64-bit codes of their bytes.

Defined cases. Null text has no words. Texts of fewer than ``size`` words lose nothing. A null
``doc_id`` is larger than any other. Rows that repeat ``doc_id`` are ordered by a hash of their
text; rows that repeat both are one place in the order, so neither is removed for the other. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from convoy.llm import repeats

SIZE, GRAM = 20, 8


def extend(
    tokens: repeats.Tokens, groups: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray
) -> np.ndarray:
    """Classes of equal runs of words, grown from their seed to the right and then to the left.

    ``seeds`` is the seed's distance from the start, the same throughout a group.
    """

    def word(items: np.ndarray, d: int) -> np.ndarray:
        rightward = seeds[items] + d
        leftward = lengths[items] - 1 - d
        at = np.where(rightward < lengths[items], rightward, np.maximum(leftward, 0))
        return tokens.values[starts[items] + at]

    return repeats.refine(groups, word, int(lengths.max(initial=0)))


def remove_repeats(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens (words), removed (begin and end of runs), kept (bytes).

    ``kept`` holds the words that stay, joined by one space. ``gram`` is a power of two below ``size``.
    """
    return repeats.without_repeats(docs, repeats.word_tokens, extend, size, gram, id_column, text_column)
