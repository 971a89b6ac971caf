"""Licence scans with a positional index of rare words.

The index holds, for every licence notice, where each of its words stands. Words weigh by their
inverse document frequency over all documents scanned. A file is looked up by each notice's words of
highest weight, as many as it cannot do without: a place that lacks them all stays below the
threshold. Each place of such a word proposes the notice at a relative position. Around the
proposed positions all indexed words of the notice are looked up in the whole file; positions that
agree within a few words (names, years and wrapped lines shift them) are taken together, and the
weight of the notice's words found there, out of all its indexed words, is the score. A notice
counts if its score reaches the threshold and its mandatory key phrases stand at that place. What
else the file holds, other notices included, changes neither.

Beside that, all places of the base phrases are listed, whatever their surroundings.

Words are runs of ASCII digits and letters (A-Z as a-z) and of all characters beyond ASCII.

Defined cases. Null or empty text has no words, places or matches. Rows that repeat ``doc_id`` are
scanned one by one. Corpus statistics of an empty table are empty, and so is its result. Other
columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from convoy.llm.common import in_arrow, slices

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening words of public licence notices, with the phrases that must be there.
NOTICES = [
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ["permission is hereby granted", "free of charge"]),
    ("mit-reference", "released under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except "
     "in compliance with the license you may obtain a copy of the license at",
     ["apache license", "except in compliance with the license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation either version of the license or at your "
     "option any later version", ["gnu general public license", "free software"]),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
     "lesser general public license as published by the free software foundation",
     ["gnu lesser general public license", "free software"]),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", ["source and binary forms", "conditions are met"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     ["with or without fee", "is hereby granted"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software", "public domain"]),
]
THRESHOLD = 0.7
RARE_PER_NOTICE = 12
SLACK = 6

# Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Index:
    """Postings of the notices' rare words, and which of them propose a notice."""

    idf: dict[bytes, float]
    threshold: float = THRESHOLD
    slack: int = SLACK
    postings: list[dict[bytes, list[int]]] = field(default_factory=list)
    proposers: list[list[bytes]] = field(default_factory=list)
    mass: list[float] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for _, text, _ in NOTICES:
            words = text.encode().split()
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[:RARE_PER_NOTICE]
            self.mass.append(sum(self.idf[w] for w in rare))
            self.lengths.append(len(words))
            self.postings.append({w: [i for i, word in enumerate(words) if word == w] for w in rare})
            # Without the first words, what is left weighs less than the threshold.
            left, first = self.mass[-1], 0
            while first < len(rare) and left >= self.threshold * self.mass[-1] - 1e-6:
                left -= self.idf[rare[first]]
                first += 1
            self.proposers.append(rare[:first])
        self.phrases = [[b" " + p.encode() + b" " for p in phrases] for _, _, phrases in NOTICES]
        self.vocabulary = frozenset(w for postings in self.postings for w in postings)

    def matches(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, score, first word, last word) of every notice found, its best place each."""
        present = self.vocabulary.intersection(words)
        if not present:
            return []
        places: dict[bytes, list[int]] = {w: [] for w in present}
        for place, word in enumerate(words):
            if word in places:
                places[word].append(place)
        out = []
        for number, postings in enumerate(self.postings):
            if sum(self.idf[w] for w in postings if w in places) < self.threshold * self.mass[number] - 1e-6:
                continue
            votes = self._votes(number, places)
            best = self._best(number, votes, words) if votes else None
            if best is not None:
                out.append((NOTICES[number][0], *best))
        return sorted(out)

    def _votes(self, number: int, places: dict[bytes, list[int]]) -> list[tuple[int, bytes]]:
        """(relative position, word) of the notice's words, near the positions that are proposed."""
        postings = self.postings[number]
        proposed = sorted(
            {place - at for w in self.proposers[number] for at in postings[w] for place in places.get(w, ())}
        )
        near: list[list[int]] = []
        for offset in proposed:
            if near and offset - self.slack <= near[-1][1] + 1:
                near[-1][1] = offset + self.slack
            else:
                near.append([offset - self.slack, offset + self.slack])
        votes = []
        for word, posted in postings.items():
            found = places.get(word, [])
            for at in posted:
                for low, high in near if found else ():
                    inside = found[bisect_left(found, low + at) : bisect_right(found, high + at)]
                    votes.extend((place - at, word) for place in inside)
        return votes

    def _best(self, number: int, votes: list[tuple[int, bytes]], words: list[bytes]) -> tuple[float, int, int] | None:
        """The place of most weight whose key phrases stand there; the first one among equals."""
        votes.sort()
        inside: dict[bytes, int] = defaultdict(int)
        weight, left, places = 0.0, 0, []
        for offset, word in votes:
            if not inside[word]:
                weight += self.idf[word]
            inside[word] += 1
            while votes[left][0] < offset - self.slack:
                gone = votes[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    weight -= self.idf[gone]
                left += 1
            if weight >= self.threshold * self.mass[number] - 1e-9:
                places.append((-weight, votes[left][0], offset))
        for negative, low, high in sorted(places):
            first, last = max(0, low), min(len(words), high + self.lengths[number])
            around = b" " + b" ".join(words[first:last]) + b" "
            if all(p in around for p in self.phrases[number]):
                return min(1.0, -negative / self.mass[number]), first, last - 1
        return None


BASE_PHRASES = [(re.compile(b" " + phrase.encode() + b"(?= )"), label) for phrase, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[str, int]]:
    """(label, first word) of every place where a base phrase stands."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE_PHRASES:
        at, number = 0, 0
        for found in phrase.finditer(line):
            number += line.count(b" ", at, found.start())
            at = found.start()
            out.append((label, number))
    return sorted(out, key=lambda x: (x[1], x[0]))


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each notice word stands, and the number of documents; all are counted.

    What comes to the driver is one number per word of the notices.
    """
    vocabulary = frozenset(w for _, text, _ in NOTICES for w in text.encode().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            counts[b""] += batch.num_rows
            for value in batch.column("text"):
                for word in vocabulary.intersection(words_of(value.as_py())):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    texts = docs.select(F.col(text_column).cast("binary").alias("text"))
    rows = in_arrow(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    total = counts.pop(b"", 0)
    return {w: counts.get(w, 0) for w in vocabulary}, total


def scan(
    docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, places (label, at) of base phrases, matches of notices.

    A match is (label, score, first, last): the notice, its weight found, and the words it spans.
    """
    frequencies, total = document_frequencies(docs, text_column)
    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in frequencies.items()}
    shared = docs.sparkSession.sparkContext.broadcast(Index(idf, threshold))
    places_type = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))
    match_type = pa.list_(
        pa.struct([("label", pa.string()), ("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, places, matches = [], [], []
                for value in batch.column("text"):
                    words = words_of(value.as_py())
                    counts.append(len(words))
                    places.append([{"label": label, "at": at} for label, at in base_places(words)])
                    matches.append(
                        [dict(zip(("label", "score", "first", "last"), m, strict=True)) for m in index.matches(words)]
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, places_type),
                     pa.array(matches, match_type)],
                    names=["doc_id", "n_words", "places", "matches"],
                )

    schema = StructType(
        [
            StructField("doc_id", docs.schema[id_column].dataType),
            *StructType.fromDDL(
                "n_words long, places array<struct<label:string,at:long>>, "
                "matches array<struct<label:string,score:double,first:long,last:long>>"
            ).fields,
        ]
    )
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return in_arrow(texts, run, schema)
