"""Near-duplicate documents by a Jaccard join on word n-grams.

1. A document becomes the set of its runs of five words. Documents with one set are one class, of
   which the least document goes on; a group of copies costs one row from here.
2. MinHash signatures are cut into bands. Band and row counts follow from the wanted recall at the
   threshold. A shuffle on band hashes brings candidates together; each candidate is tied to the
   least of its band, which gives as many links as members and never pairs.
3. Candidates that hang together are verified on their full sets. A group is cut into blocks and
   every pair of blocks is one unit of work that counts all shared n-grams at once, so no pair is
   a row. It returns, for each document, how many it is linked to and one link that holds its
   component together.

All pairs at or above the threshold that share a band or a group are found; nothing is capped. A
group of m candidates takes m squared over the block size units of rows, and is the only thing here
that is not linear; that is the price of exact numbers of links.

Defined cases. Null text has no words. Documents without words are linked to none. Documents of one
to four words have one n-gram, their whole text. A null ``doc_id`` is larger than any other. Rows
that repeat ``doc_id`` count as documents of their own, told apart by a hash of their text; rows
that repeat both are copies. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import buffers, discard, in_arrow, slices, stored, text_or_empty
from convoy.llm.components import components
from convoy.llm.repeats import LAST, SLICE, identity, word_tokens

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
BLOCK_DOCS, BLOCK_GRAMS = 1024, 500_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that meets ``recall``.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    found = (1, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            found = (bands, rows)
    return found


def gram_sets(flat: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets of n-gram codes, sorted within a row, as one array, and where each row begins."""
    tokens = word_tokens(flat, offsets)
    codes, rows = tokens.codes(0, int(tokens.rows[-1])), tokens.rows
    with np.errstate(over="ignore"):
        grams = codes
        for i in range(1, gram):
            grams = grams[:-1] * _MUL + codes[i:] if len(codes) > i else codes[:0]
        # Short rows: all their words at once, from their last word back to their first.
        lengths = np.diff(rows)
        short = np.flatnonzero((lengths > 0) & (lengths < gram))
        whole = np.zeros(len(short), np.uint64)
        for i in range(gram - 1):
            some = lengths[short] > i
            whole[some] = whole[some] * _MUL + codes[rows[short[some]] + i]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(codes)) + gram <= rows[1:][owner]
        starts = np.flatnonzero(inside)
        value = np.concatenate([grams[starts], whole])
        value = (value ^ (value >> np.uint64(32))) * _MUL
    owner = np.concatenate([owner[starts], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(lengths) + 1))


def band_hashes(value: np.ndarray, begins: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One hash per row and band, of the band's minima; rows without n-grams get zeros."""
    full = np.flatnonzero(np.diff(begins) > 0)
    out = np.zeros((len(begins) - 1, bands), np.uint64)
    if not len(full):
        return out
    rng = np.random.default_rng(seed)
    low = (value >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for band in range(bands):
            mixed = np.full(len(full), np.uint64(band + 1))
            for _ in range(rows):
                flip, factor = rng.integers(0, 1 << 32, 2, dtype=np.uint32)
                least = np.minimum.reduceat((low ^ flip) * (factor | np.uint32(1)), begins[full])
                mixed = (mixed ^ least) * _MUL
                mixed ^= mixed >> np.uint64(29)
            out[full, band] = mixed
    return out


def signatures(texts: DataFrame, gram: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc, alt, grams (set's digest; null without words), n, bands for every row of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                value, begins = gram_sets(*buffers(batch.column("text")), gram)
                hashes = band_hashes(value, begins, bands, rows, seed).view(np.int64)
                raw, at = memoryview(value.tobytes()), (begins * 8).tolist()
                digests = [
                    hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None
                    for a, b in zip(at[:-1], at[1:], strict=True)
                ]
                offsets = np.arange(len(hashes) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc"),
                        batch.column("alt"),
                        pa.array(digests, pa.binary()),
                        pa.array(np.diff(begins).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel())),
                    ],
                    names=["doc", "alt", "grams", "n", "bands"],
                )

    return in_arrow(texts, run, "doc long, alt long, grams binary, n long, bands array<long>")


def sets_of(texts: DataFrame, gram: int) -> DataFrame:
    """``texts`` with their sets of n-grams (sorted 64-bit codes as bytes) in place of ``text``."""
    schema = "root struct<doc:long,alt:long>, doc long, alt long, weight long, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                value, begins = gram_sets(*buffers(batch.column("text")), gram)
                at = pa.py_buffer((begins * 8).astype(np.int32))
                sets = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at, pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("root", "doc", "alt", "weight")] + [sets],
                    names=["root", "doc", "alt", "weight", "grams"],
                )

    return in_arrow(texts.select("root", "doc", "alt", "weight", "text"), run, schema)


def shared_counts(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many codes every two of ``n`` sets share."""
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    counts = np.diff(np.append(head, len(value)))
    shared = np.zeros((n, n), np.float32)
    # A rare code adds its few pairs; frequent ones are multiplied as columns of a matrix.
    rare = min(16, n // 4)
    for m in range(2, rare + 1):
        which = owner[head[counts == m][:, None] + np.arange(m)]
        if not len(which):
            continue
        pairs = np.zeros(n * n, np.int64)
        for i in range(m):
            for j in range(m):
                pairs += np.bincount(which[:, i] * n + which[:, j], minlength=n * n)
        shared += pairs.reshape(n, n)
    frequent = np.flatnonzero(counts > max(rare, 1))
    width = max(1, (8 << 20) // max(n, 1))
    for at in range(0, len(frequent), width):
        part = frequent[at : at + width]
        column = np.repeat(np.arange(len(part)), counts[part])
        first = np.cumsum(counts[part]) - counts[part]
        rows = owner[np.repeat(head[part] - first, counts[part]) + np.arange(int(counts[part].sum()))]
        matrix = np.zeros((n, len(part)), np.float32)
        matrix[rows, column] = 1
        shared += matrix @ matrix.T
    return shared


def verified(value: np.ndarray, owner: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which two sets have a Jaccard similarity of at least ``threshold``."""
    n = len(sizes)
    shared = shared_counts(value, owner, n).astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - shared
    near = shared >= threshold * union - 1e-9
    np.fill_diagonal(near, False)
    return near


def roots_of(near: np.ndarray) -> np.ndarray:
    """The least member of every member's component."""
    roots = np.arange(len(near))
    while True:
        least = np.minimum(roots, np.where(near, roots[None, :], len(near)).min(axis=1, initial=len(near)))
        least = least[least]
        if (least == roots).all():
            return roots
        roots = least


def _check(group: pa.Table, threshold: float) -> pa.RecordBatch:
    """Numbers of links and a root for the documents of two blocks of one group of candidates."""
    doc, alt = group.column("doc").to_numpy(), group.column("alt").to_numpy()
    order = np.lexsort((alt, doc))
    again = (np.diff(doc[order]) == 0) & (np.diff(alt[order]) == 0)
    order = order[np.append(True, ~again)]  # a row that is repeated counts once here, by its class's weight
    group = group.take(pa.array(order))
    doc, alt = doc[order], alt[order]
    flat, offsets = buffers(group.column("grams"))
    sizes = np.diff(offsets) // 8
    value = np.frombuffer(flat.tobytes(), np.uint64)
    near = verified(value, np.repeat(np.arange(len(doc)), sizes), sizes.astype(np.float64), threshold)
    block, low, high = (group.column(c).to_numpy() for c in ("block", "low", "high"))
    if low[0] != high[0]:
        near &= block[:, None] != block[None, :]
    links = (near * group.column("weight").to_numpy()[None, :]).sum(axis=1)
    some = np.flatnonzero(links > 0)
    root = roots_of(near)[some]
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (doc[some], alt[some], links[some].astype(np.int64), doc[root], alt[root])],
        names=["doc", "alt", "links", "root_doc", "root_alt"],
    )


def checked(sets: DataFrame, threshold: float) -> DataFrame:
    """doc, alt, links, root_doc, root_alt: what every pair of blocks of a group of candidates finds."""
    sets = sets.withColumn("n", F.length("grams") / 8)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_GRAMS)).cast("int")
    totals = sets.groupBy("root").agg(blocks.alias("blocks"))
    keys = ["root_doc", "root_alt", "low", "high"]
    dealt = (
        sets.join(totals, "root")
        .withColumn("block", F.pmod(F.xxhash64("doc", "alt"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("root.doc").alias("root_doc"),
            F.col("root.alt").alias("root_alt"),
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "doc",
            "alt",
            "weight",
            "grams",
        )
    )
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table.column(k).to_numpy() for k in keys]
            new = np.zeros(table.num_rows, dtype=bool)
            for column in key:
                new[1:] |= column[1:] != column[:-1]
            ends = np.flatnonzero(new)
            for begin, end in zip(np.append(0, ends)[:-1], ends, strict=True):
                yield _check(table.slice(begin, end - begin), threshold)
            held = table.slice(int(ends[-1]) if len(ends) else 0).to_batches()
        if held:
            yield _check(pa.Table.from_batches(held), threshold)

    return in_arrow(dealt, run, "doc long, alt long, links long, root_doc long, root_alt long")


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    gram: int = GRAM,
    recall: float = RECALL,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id, rep_id, n_links.

    ``class_id`` is the least document that it is linked to, over any number of links; ``rep_id``
    the least document with the same set of n-grams; ``n_links`` the number of other documents at
    or above the threshold, copies included.
    """
    bands, rows = banding(threshold, recall)
    texts = docs.select(*identity(id_column, text_column), text_or_empty(text_column).cast("binary").alias("text"))
    node = F.struct("doc", "alt")
    signed = stored(signatures(texts, gram, bands, rows, seed).withColumn("node", node), "signatures")
    classes = stored(
        signed.where("grams is not null")
        .groupBy("grams")
        .agg(F.min(F.struct("node", "n", "bands")).alias("rep"), F.count("*").alias("weight"))
        .select("grams", "rep.node", "weight", "rep.bands"),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    least = banded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    tied = banded.join(least, ["band", "hash"]).select(F.col("node").alias("u"), F.col("least").alias("v"))
    groups = components(tied)
    grouped = groups.join(classes.select("node", "weight"), "node").select("root", "node.doc", "node.alt", "weight")
    chosen = texts.join(grouped, ["doc", "alt"])
    sets = stored(sets_of(chosen, gram), "gram-sets")
    found = stored(checked(sets, threshold), "links-found")
    linked = found.groupBy("doc", "alt").agg(F.sum("links").alias("links"))
    held = components(found.select(F.struct("doc", "alt").alias("u"), F.struct(F.col("root_doc").alias("doc"), F.col("root_alt").alias("alt")).alias("v")))
    classes_of = (
        classes.select("grams", F.col("node").alias("rep"), "weight")
        .join(held.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .join(linked.select(F.struct("doc", "alt").alias("rep"), "links"), "rep", "left")
    )
    every = signed.select("doc", "node", "grams").join(classes_of, "grams", "left")
    discard(sets)
    id_type = dict(docs.dtypes)[id_column]

    def number(of: str) -> Column:
        return F.when(F.col(of) != LAST, F.col(of)).cast(id_type)

    named = every.select(
        "doc",
        F.coalesce("root", "rep", "node").alias("class"),
        F.coalesce("rep", "node").alias("rep"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"),
        F.col("node.alt").alias("alt"),
    )
    return named.select(
        number("doc").alias("doc_id"),
        number("class.doc").alias("class_id"),
        number("rep.doc").alias("rep_id"),
        "n_links",
        (F.col("class") == F.struct("doc", "alt")).alias("first"),
        "alt",
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """The least document of every class, with the columns of ``docs``; of rows that repeat id and text, one."""
    firsts = jaccard_join(docs, id_column=id_column, text_column=text_column, **options).where("first")
    firsts = firsts.groupBy("doc_id", "alt").agg(F.count("*").alias("rows"))
    firsts = stored(firsts, "firsts")
    # The row goes as one value, so none of its columns can clash with what is added here.
    keyed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"),
        F.col(id_column).alias("id"),
        F.xxhash64(text_or_empty(text_column)).alias("hash"),
    ).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.hash") == F.col("f.alt"))
    alone = keyed.join(firsts.where("rows = 1").alias("f"), same, "left_semi")
    repeated = keyed.join(firsts.where("rows > 1").alias("f"), same, "left_semi").dropDuplicates(["id", "hash"])
    return alone.unionByName(repeated).select("row.*")
