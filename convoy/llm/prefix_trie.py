"""The trie of shared conversation prefixes, by composable fingerprints.

A conversation may take its first turns from another one: it is rebuilt from the first
``heads`` turns of its base and its own turns after as many. The trie has a node for every distinct
sequence of first turns of rebuilt conversations, and tells how much text they share.

Fingerprints. A run of turns is an element of a monoid: its number of turns n and, for each of four
primes P, the sum of t(i) B^i mod P over its turns, where t is taken from the SHA-256 of role and
text. Two runs combine as (n, x) (m, y) = (n + m, x + B^n y). A running sum over a conversation gives
the products of all its prefixes, a difference of two and a power of B the product of any suffix,
and head times suffix the fingerprint of a rebuilt prefix. No rebuilt text is ever put together:
a rebuilt turn is a row of numbers that refers to the stored turn.

Verification. Prefixes with one depth and fingerprint form a group. A group is a node if all its
members agree in the fingerprint of their parent and in the SHA-256 of their last turn, and turns
of one SHA-256 are compared by role and text, as least and greatest of them. By induction the
members' sequences are equal. If a group fails, the work is done again with another base.

Subtree sums without walking the trie. Every node is owned by its smallest member. A conversation
owns its nodes from some depth on, so what lies below a node is told by one row per member and
depth: children are the owners one turn further, leaves the owners of last nodes, and texts of
distinct nodes are counted by their owner only. Sums over members are partial aggregates.

Hot keys. Turns are numbered and summed by ranges of (conversation, turn), so one conversation may
hold a third of all turns. Groups are aggregated before their shuffle. Ids of the conversations that
end at a node are joined in blocks of ids before their digest is taken in one stream.

Defined cases. Null role or text is empty; a null turn comes first; turns of one number are ordered
by the SHA-256 of role and text, and repeated rows are turns of their own. Rows without a
conversation id take no part. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import in_arrow, stored
from convoy.operators import scan

# Primes below 2^31, so that a product of two residues fits 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LANES = tuple(range(len(PRIMES)))
SHA = tuple(f"sha{i}" for i in range(4))
# A conversation has fewer turns than 2 to this.
TURN_BITS = 31
# Ids that agree but for so many low bits are joined before they are streamed into a digest.
BLOCK_BITS = 12


def _bases(seed: int) -> list[int]:
    digest = [hashlib.sha256(f"prefix:{seed}:{k}".encode()).digest() for k in LANES]
    return [2 + int.from_bytes(d[:8], "big") % (p - 3) for d, p in zip(digest, PRIMES, strict=True)]


def _power(base: int, prime: int, exponent: Column) -> Column:
    """``base`` to a power that may be negative, by the powers of two in it."""

    def positive(b: int, e: Column) -> Column:
        squares = F.array(*[F.lit(pow(b, 1 << k, prime)).cast("long") for k in range(TURN_BITS)])
        return F.aggregate(
            F.sequence(F.lit(0), F.length(F.bin(e)) - 1),
            F.lit(1).cast("long"),
            lambda done, k: F.when(
                F.getbit(e, k) == 1, done * F.get(squares, k) % prime
            ).otherwise(done),
        )

    inverse = pow(base, -1, prime)
    return F.when(exponent == 0, F.lit(1).cast("long")).when(
        exponent > 0, positive(base, F.abs(exponent))
    ).otherwise(positive(inverse, F.abs(exponent)))


def turns_of(conversations: DataFrame, seed: int) -> DataFrame:
    """Every turn: conv_id, seq (from 0), n_chars, its digest, and products of the turns up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps (ab, c) and (a, bc) apart.
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.sha2(told.cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(c) for i, c in enumerate(SHA)]
    named = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        *parts,
        F.length(text).cast("long").alias("n_chars"),
    )
    order = ["has_turn", "turn", *SHA]
    # One split into ranges serves the numbers and the sums.
    tagged = scan.split_in_order(stored(named, "turn-digests"), ["conv_id"], order)
    numbered = scan.running(tagged, ["conv_id"], order, sums={"upto": F.lit(1).cast("long")})
    numbered = numbered.withColumn("seq", F.col("upto") - 1).drop("upto", "has_turn", "turn")
    own = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *SHA), F.lit(p)) for k, p in zip(LANES, PRIMES, strict=True)]
    terms = {
        f"term{k}": own[k] * _power(base, PRIMES[k], F.col("seq")) % PRIMES[k] for k, base in enumerate(_bases(seed))
    }
    # Terms are below 2^31, so their sums fit 64 bits for any number of turns that TURN_BITS allows.
    sums = {f"upto{k}": F.col(f"term{k}") for k in LANES} | {"chars_upto": F.col("n_chars")}
    summed = scan.running(numbered.withColumns(terms), ["conv_id"], ["seq"], sums=sums)
    lanes = [(F.col(f"upto{k}") % PRIMES[k]).alias(f"upto{k}") for k in LANES]
    return summed.select("conv_id", "seq", "n_chars", "chars_upto", *SHA, *[f"term{k}" for k in LANES], *lanes)


def rebuilt_prefixes(turns: DataFrame, base: Column, heads: Column, most_heads: int, seed: int) -> DataFrame:
    """A row per rebuilt conversation and depth of at least 1: its prefix's fingerprint, its parent's,
    the digest and length of its last turn, the characters so far, and the conversation's totals."""
    lane = [f"upto{k}" for k in LANES]
    before = F.col("seq") == F.col("heads") - 1
    of_conv = (
        turns.select("conv_id", "seq", "chars_upto", *lane, heads.alias("heads"))
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_own"),
            F.first("heads").alias("heads"),
            F.max("chars_upto").alias("own_chars"),
            *[F.max(F.when(before, F.col(c))).alias(f"cut_{c}") for c in (*lane, "chars_upto")],
        )
    )
    of_conv = of_conv.withColumn("base_id", base)
    # At most ``most_heads`` turns of a conversation that others are based on.
    first = turns.where(F.col("seq") < most_heads).select(F.col("conv_id").alias("base_id"), F.struct(
        "seq", "n_chars", "chars_upto", *SHA, *[f"term{k}" for k in LANES], *lane).alias("t"))
    first = first.join(of_conv.select("base_id").distinct(), "base_id", "left_semi")
    base_heads = first.groupBy("base_id").agg(F.array_sort(F.collect_list("t")).alias("all_heads"))
    none = F.array().cast(base_heads.schema["all_heads"].dataType)
    convs = (
        of_conv.join(base_heads, "base_id", "left")
        .withColumn("head", F.slice(F.coalesce("all_heads", none), F.lit(1), F.col("heads").cast("int")))
        .withColumn("n_head", F.size("head").cast("long"))
        .withColumn("n_suffix", F.greatest(F.col("n_own") - F.col("heads"), F.lit(0)))
        .withColumn("length", F.col("n_head") + F.col("n_suffix"))
        .withColumn("last_head", F.try_element_at("head", F.lit(-1)))
    )
    convs = convs.select(
        "conv_id", "heads", "head", "n_head", "length", "n_suffix",
        *[F.coalesce(F.col(f"last_head.{c}"), F.lit(0)).alias(f"head_{c}") for c in (*lane, "chars_upto")],
        *[F.when(F.col("n_suffix") > 0, F.coalesce(f"cut_{c}", F.lit(0))).otherwise(F.lit(0)).alias(f"cut_{c}") for c in (*lane, "chars_upto")],
        "own_chars",
    ).withColumn(
        "total", F.col("head_chars_upto") + F.when(F.col("n_suffix") > 0, F.col("own_chars") - F.col("cut_chars_upto")).otherwise(0)
    )
    convs = stored(convs, "rebuilt-conversations")
    kept = ["conv_id", "length", "total"]
    out = ["depth", "n_chars", "chars_upto", *SHA, *[f"term{k}" for k in LANES], *lane]
    from_head = convs.select(*kept, F.inline("head")).select(*kept, (F.col("seq") + 1).alias("depth"), *out[1:])
    # Head times suffix: own products from the cut on, moved by B to the power of how far turns move.
    moved = F.col("n_head") - F.col("heads")
    shifts = [_power(b, PRIMES[k], moved).alias(f"shift{k}") for k, b in enumerate(_bases(seed))]
    slim = convs.where("n_suffix > 0").select(
        *kept, "heads", "n_head", *[c for c in convs.columns if c.startswith(("head_", "cut_"))], *shifts
    )
    own = turns.join(slim, "conv_id").where(F.col("seq") >= F.col("heads"))
    combined = [
        ((F.col(f"head_{c}") + F.pmod(F.col(c) - F.col(f"cut_{c}"), F.lit(PRIMES[k])) * F.col(f"shift{k}")) % PRIMES[k]).alias(c)
        for k, c in enumerate(lane)
    ]
    from_own = own.select(
        *kept,
        (F.col("n_head") + F.col("seq") - F.col("heads") + 1).alias("depth"),
        "n_chars",
        (F.col("head_chars_upto") + F.col("chars_upto") - F.col("cut_chars_upto")).alias("chars_upto"),
        *SHA,
        *[(F.col(f"term{k}") * F.col(f"shift{k}") % PRIMES[k]).alias(f"term{k}") for k in LANES],
        *combined,
    )
    both = from_head.unionByName(from_own)
    above = [F.pmod(F.col(c) - F.col(f"term{k}"), F.lit(PRIMES[k])) for k, c in enumerate(lane)]
    # Two residues in one number: below 2^62.
    pair = [F.shiftleft(lane_a, 31).bitwiseOR(lane_b) for lane_a, lane_b in ((F.col(lane[0]), F.col(lane[1])), (F.col(lane[2]), F.col(lane[3])))]
    pair_above = [F.shiftleft(a, 31).bitwiseOR(b) for a, b in ((above[0], above[1]), (above[2], above[3]))]
    prefixes = both.select(
        *kept, "depth", "n_chars", "chars_upto", *SHA,
        pair[0].alias("x"), pair[1].alias("y"), pair_above[0].alias("above_x"), pair_above[1].alias("above_y"),
    )
    zero = F.lit(0).cast("long")
    roots = convs.select(
        *kept, zero.alias("depth"), zero.alias("n_chars"), zero.alias("chars_upto"), *[zero.alias(c) for c in SHA],
        *[zero.alias(c) for c in ("x", "y", "above_x", "above_y")],
    )
    return prefixes.unionByName(roots)


NODE = ["depth", "x", "y"]


def _grouped(prefixes: DataFrame) -> DataFrame:
    """Groups of one depth and fingerprint, and whether their members agree in parent and last turn."""
    same = [*SHA, "above_x", "above_y", "chars_upto"]
    agree = F.lit(True)
    for c in same:
        agree = agree & (F.col(f"low_{c}") == F.col(f"high_{c}"))
    return (
        prefixes.groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("length").alias("longest"),
            F.max("n_chars").alias("n_chars"),
            *[F.min(c).alias(f"low_{c}") for c in same],
            *[F.max(c).alias(f"high_{c}") for c in same],
        )
        .withColumn("agree", agree)
        .select(*NODE, "conv_id", "n_convs", "longest", "n_chars", F.col("low_chars_upto").alias("chars_upto"),
                F.col("low_above_x").alias("above_x"), F.col("low_above_y").alias("above_y"), "agree")
    )


def digests_hold(conversations: DataFrame) -> bool:
    """Whether turns of one SHA-256 are of one role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.sha2(told.cast("binary"), 256).alias("sha"), told.alias("told"))
    # One row per digest and task leaves before the shuffle, however often a turn is repeated.
    sides = turns.groupBy("sha").agg(F.min("told").alias("low"), F.max("told").alias("high"))
    return sides.where("low <> high").isEmpty()


def _ends(prefixes: DataFrame) -> DataFrame:
    """Per node at which conversations end, the digest of their ids in ascending order."""
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    blocks = (
        prefixes.where("depth = length")
        .groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block"))
        .agg(ids.alias("ids"))
    )
    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*NODE, "ends_sha256")}
            for *mine, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if mine != key:
                    if key is not None:
                        for c, v in zip(out, [*key, digest.hexdigest()], strict=True):
                            out[c].append(v)
                    key, digest = mine, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(schema.names, [*key, digest.hexdigest()], strict=True)}, schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
    return in_arrow(dealt.select(*NODE, "ids"), run, "depth long, x long, y long, ends_sha256 string")


def trie(
    conversations: DataFrame,
    base: Callable[[Column], Column],
    heads: Callable[[Column], Column],
    most_heads: int,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and its fingerprint (x, y).

    ``base`` and ``heads`` say of a conversation id whose first turns it takes and how many, at most
    ``most_heads``.
    """
    conv = F.col("conv_id")
    if not digests_hold(conversations):
        raise ValueError("two different turns have the same SHA-256")
    seed = 0
    while True:
        turns = stored(turns_of(conversations, seed), "turns")
        prefixes = stored(rebuilt_prefixes(turns, base(conv), heads(conv), most_heads, seed), "prefixes")
        nodes = stored(_grouped(prefixes), "nodes")
        if nodes.where("not agree").isEmpty():
            break
        seed += 1
    # What a conversation owns: its nodes from ``owned`` on, and the text before them.
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owned"),
        F.min(F.col("chars_upto") - F.col("n_chars")).alias("text_before"),
        F.max(F.when(F.col("longest") == F.col("depth"), F.col("depth"))).alias("leaf"),
    )
    members = prefixes.select("conv_id", "length", "total", *NODE, "n_chars", "chars_upto").join(owners, "conv_id", "left")
    below = F.col("total") - F.col("chars_upto") + F.col("n_chars")
    counted_once = F.when(
        F.col("owned") <= F.col("length"),
        F.when(F.col("owned") <= F.col("depth"), below).otherwise(F.col("total") - F.col("text_before")),
    ).otherwise(0)
    child = (F.col("owned") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    sums = members.groupBy(*NODE).agg(
        F.count_if(child).alias("n_children"),
        F.count_if(F.col("leaf") == F.col("length")).alias("n_leaves"),
        F.sum(below - F.coalesce(counted_once, F.lit(0))).alias("saved_tokens"),
    )
    parents = nodes.where("longest > depth").select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("above_x"), F.col("y").alias("above_y"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        nodes.join(sums, NODE)
        .join(_ends(prefixes), NODE, "left")
        .join(parents, ["depth", "above_x", "above_y"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "x", "y",
        )
    )
