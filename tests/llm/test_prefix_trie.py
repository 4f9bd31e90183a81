import hashlib
import random
from zlib import crc32

from pyspark.sql import functions as F

from tillwatch.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(convs):
    """convs: id to list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        children = sum(len(m) == len(node) + 1 for m in below)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256").collect()), key=repr)


def trie_of(spark, convs, extra=()):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + list(extra)
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    return prefix_trie.sequences(turns)


def test_against_plain_trie(spark):
    draw = random.Random(5)
    convs = {}
    for c in range(-3, 60):
        n = draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17])
        convs[c] = [(draw.choice("ua"), draw.choice(["", "é", "yes"])) if draw.random() < 0.4 else ("u", "same") for _ in range(n)]
    convs[100] = convs[101] = convs[5]
    convs[102] = convs[5] + [("u", "x" * 5000)]
    assert got(prefix_trie.prefix_trie(trie_of(spark, convs))) == brute(convs)


def test_nulls_ties_and_extra_columns(spark):
    rows = [
        (1, None, None, "first"), (1, 3, "u", None), (1, 3, "u", None), (2, None, "", "first"), (2, 9, "u", ""),
        (None, 0, "u", "nowhere"), (3, 5, "u", "a"), (3, 5, "a", "b"),
    ]
    turns = spark.createDataFrame([(*r, b"n", 7) for r in rows], TURNS + ", name binary, n int")
    want = {1: [("", "first"), ("u", ""), ("u", "")], 2: [("", "first"), ("u", "")], 3: [("a", "b"), ("u", "a")]}
    assert got(prefix_trie.prefix_trie(prefix_trie.sequences(turns))) == brute(want)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(turns.limit(0))).count() == 0


def test_shared_starts_and_turnless(spark):
    own = {c: [("u", f"{c}-{i}") for i in range(n)] for c, n in {0: 6, 1: 4, 2: 1, 5: 3, 6: 9, 12: 2, 13: 8, 27: 1, 28: 2}.items()}
    convs = prefix_trie.with_shared_starts(trie_of(spark, own), F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9)
    want = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert any(not turns for turns in want.values())
    assert got(prefix_trie.prefix_trie(convs)) == brute(want)
    nothing = convs.select("conv_id", F.unhex(F.lit("")).alias("seq"))
    assert got(prefix_trie.prefix_trie(nothing)) == brute({c: [] for c in own})


def test_long_lists_of_ends_are_digested_in_chunks(spark):
    convs = spark.range(-500, 5000).select(F.col("id").alias("conv_id"), F.unhex(F.lit("")).alias("seq")).repartition(5)
    name, digest = prefix_trie.ends_digests(convs, 0, chunk_bits=3).first()
    assert bytes(name) == prefix_trie.ROOT
    assert digest == hashlib.sha256(",".join(map(str, range(-500, 5000))).encode()).hexdigest()


def test_long_conversation_beside_short_ones(spark):
    convs = {1: [("u", str(i)) for i in range(300)], 2: [("u", str(i)) for i in range(257)], 3: [("u", "0"), ("u", "x")]}
    assert got(prefix_trie.prefix_trie(trie_of(spark, convs))) == brute(convs)
