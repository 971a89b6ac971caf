import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from convoy.llm import prefix_trie as pt
from convoy.llm.queries import op13_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def direct(rows):
    """The trie of rebuilt texts, node by node."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, struct.unpack(">4q", digest), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, mine in members.items():
        below = [k for k in members if k[: len(node)] == node]
        inner = {k[:-1] for k in members if k}
        ends = ",".join(str(c) for c in sorted(mine) if len(rebuilt[c]) == len(node))
        out.append((
            min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine),
            sum(k[:-1] == node for k in members if k), sum(k not in inner for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie(table):
    return pt.trie(table, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string").cast("binary")) % 6, 5)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = direct([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(op13_prefix_trie(spark, sf)) == want


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 112), *range(200, 205), 301, -3, -100, -120]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "a", None, ""]), rng.choice(["x", "yé", "", None, "x"])))
    # One conversation holds a third of all turns, and some rows are repeated or lack an id.
    rows += [(207, t, "u", f"t{t % 3}") for t in range(len(rows) // 2)] + rows[:5] + [(None, 0, "u", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = table.withColumns({n: F.lit(1) for n in ("seq", "depth", "x", "length", "base_id", "heads", "t")})
    assert rows_of(trie(clashing.repartition(5))) == direct(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(empty).count() == 0


def test_collisions_change_the_base(spark, monkeypatch):
    """Fingerprints that all collide at first are found out and made anew."""
    rows = [(c, t, "u", f"{c % 3} {t}") for c in range(12) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real, seeds = pt.rebuilt_prefixes, []

    def blind(turns, base, heads, most, seed):
        seeds.append(seed)
        made = real(turns, base, heads, most, seed)
        return made.withColumn("x", F.when(F.col("depth") > 0, 1).otherwise(F.col("x")).cast("long")).withColumn("y", F.lit(0).cast("long")) if not seed else made

    monkeypatch.setattr(pt, "rebuilt_prefixes", blind)
    assert rows_of(trie(table)) == direct(rows)
    assert seeds == [0, 1]
