"""Trie of the prefixes that conversations share, built by van Emde Boas recursion.

A conversation is the sequence of its turns' digests. Sequences of at most 2**k turns are cut after
2**(k-1): the cut prefix gets a name from the name of the node it starts at and its digests; the first
halves make the upper trie, what is left makes one lower trie below each name. All tries of a
level are cut together, equal parts are merged with their counts, and after k levels every part is one
turn, which is a node. A node at depth d is named at the level of the lowest bit of d, and remembers
its ancestors at the distances 1, 2, 4, ... up to that bit.

Totals are grafted upward along the same cuts: first the tries below each cut node are summed from
the smallest to the largest, then the sums of lower tries are handed to the nodes of the upper ones.
Every step shuffles nodes, never pairs of a node and all its ancestors, and there are 2k of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.session import materialise, prepare

#: Bytes of a turn in a sequence: the digest of role and text, and the number of bytes of the text.
UNIT = 20
#: Name of the node without turns.
ROOT = hashlib.md5(b"").digest()
#: Conversations whose ids agree but for so many low bits are listed together before they are digested.
CHUNK_BITS = 16


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the turns of each conversation in order, 20 bytes each.

    ``turns``: conv_id, turn, role, text. Turns go by ``turn`` (null first), ties by role and digest; null
    roles and texts are empty; rows without conv_id take no part. Repeated rows are turns of
    their own. A conversation is one row here, of 20 bytes a turn; texts are not shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    unit = F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    units = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), unit.alias("unit"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "unit")
    numbered = units.select("conv_id", F.row_number().over(place).alias("n"), "unit")
    listed = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "unit"))).alias("units"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("units", lambda u: u["unit"]), "")).alias("seq"))


def with_shared_starts(convs: DataFrame, base: Column, taken: Column) -> DataFrame:
    """(conv_id, seq) in which the first ``taken`` turns are those of conversation ``base``.

    All turns of ``base`` if it has fewer, none if it is null or absent; the rest is what the conversation
    has itself after its first ``taken`` turns.
    """
    own = convs.select("conv_id", "seq", base.alias("base"), taken.cast("int").alias("taken"))
    starts = convs.select(F.col("conv_id").alias("base"), F.col("seq").alias("start"))
    rest = F.expr(f"substring(seq, {UNIT} * taken + 1, octet_length(seq))")
    start = F.coalesce(F.expr(f"substring(start, 1, {UNIT} * taken)"), F.unhex(F.lit("")))
    return own.join(starts, "base", "left").select("conv_id", F.concat(start, rest).alias("seq"))


def _depth_bits(convs: DataFrame) -> int:
    longest = convs.agg(F.max(F.octet_length("seq"))).first()[0] or 0
    return (longest // UNIT).bit_length()


def _end_name(bits: int) -> Column:
    """Name of the node at which ``seq`` ends: one digest for each set bit of its length, the highest first."""
    if bits == 0:
        return F.lit(ROOT)
    return F.expr(
        f"""aggregate(sequence({bits - 1}, 0, -1), X'{ROOT.hex()}', (name, bit) -> CASE
            WHEN getbit(octet_length(seq) div {UNIT}, bit) = 1 THEN unhex(md5(concat(name, substring(
                seq, cast(octet_length(seq) div shiftleft({2 * UNIT}, bit) AS int) * shiftleft({2 * UNIT}, bit) + 1, shiftleft({UNIT}, bit)))))
            ELSE name END)"""
    )


def nodes_of(convs: DataFrame, bits: int) -> DataFrame:
    """Nodes other than the root: name, ancestors (at distances 1, 2, 4, ...), depth, n_convs, conv_id, bytes.

    One shuffle for each halving of the depth; equal parts are counted before it.
    """
    parts = convs.where("octet_length(seq) > 0").groupBy("seq").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    parts = parts.select(
        F.lit(ROOT).alias("root"), F.lit(0).alias("depth"), "seq", F.lit(None).cast("binary").alias("end"), F.lit(None).cast("binary").alias("above"), "n_convs", "conv_id"
    )
    empty = F.unhex(F.lit(""))
    for bit in reversed(range(bits)):
        size = UNIT << bit
        reaches = F.octet_length("seq") >= size
        begin = F.expr(f"substring(seq, 1, {size})")
        named = parts.withColumn("cut", F.when(reaches, _digest("root", begin)))
        # A whole part has an end that was named before; its ancestor at its own length is its root.
        upper = F.struct(
            F.col("root"), F.col("depth"), begin.alias("seq"), F.col("cut").alias("end"), F.when(reaches, F.col("root")).alias("above")
        )
        lower = F.struct(
            F.col("cut").alias("root"),
            (F.col("depth") + (1 << bit)).alias("depth"),
            F.expr(f"substring(seq, {size + 1}, {size})").alias("seq"),
            F.col("end"),
            F.when(F.col("end").isNotNull(), F.concat("cut", F.coalesce("above", empty))).alias("above"),
        )
        both = named.select(F.explode(F.array(upper, lower)).alias("part"), "n_convs", "conv_id").select("part.*", "n_convs", "conv_id").where("octet_length(seq) > 0")
        parts = both.groupBy("root", "depth", "seq", "end", "above").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return parts.select(
        F.col("end").alias("name"),
        F.col("root").alias("parent"),
        "above",
        (F.col("depth") + 1).alias("depth"),
        "n_convs",
        "conv_id",
        F.conv(F.hex(F.expr("substring(seq, 17, 4)")), 16, 10).cast("long").alias("bytes"),
    )


def _ancestor(bit: int) -> Column:
    """Name of the ancestor at distance 2**bit."""
    return F.substring("above", 16 * bit + 1, 16)


def _level(depth: Column) -> Column:
    """Number of the lowest set bit."""
    return F.bit_count(depth.bitwiseXOR(depth - 1)) - 1


def graft(nodes: DataFrame, bits: int, sums: list[str]) -> DataFrame:
    """(name, *sums): sums of the columns ``sums`` over the nodes below each node, itself not included.

    Nodes with nothing below them are left out. A node of level t (lowest set bit of its depth) first gets the sum over the
    trie of height 2**t below it: of its children, and of the tries of the nodes at distance
    1, 2, 4, ... below 2**t. Then, from the highest level on, it gets what lies below the nodes at distance 2**t.
    """
    totals = [F.sum(c).alias(c) for c in sums]
    rows = nodes.withColumn("level", F.when(F.col("depth") == 0, bits).otherwise(_level(F.col("depth"))))
    # What is sent to nodes, with the level of the receiver.
    sent = [materialise(rows.where("depth > 0").groupBy(F.col("parent").alias("name"), _receiver(0, bits)).agg(*totals), "below")]
    tries = []
    for t in range(bits + 1):
        got = _united(sent).where(F.col("receiver") == t).groupBy("name").agg(*totals)
        own = rows.where(F.col("level") == t).join(got, "name", "left").select("name", "depth", "above", "level", *[F.coalesce(got[c], F.lit(0)).alias(c) for c in sums])
        tries.append(materialise(own, "tries"))
        if t < bits:
            # A node of level t is handed to its farthest known ancestor.
            sent.append(materialise(tries[t].groupBy(_ancestor(t).alias("name"), _receiver(t, bits)).agg(*totals), "below"))
    done = [tries[bits].select("name", "above", "level", *sums)]
    for t in reversed(range(bits)):
        lower = _united(done).where(F.col("level").between(t + 1, bits - 1)).groupBy(_ancestor(t).alias("name")).agg(*totals)
        own = tries[t].join(lower, "name", "left").select("name", "above", "level", *[(tries[t][c] + F.coalesce(lower[c], F.lit(0))).alias(c) for c in sums])
        done.append(materialise(own, "grafted"))
    return _united(done).select("name", *sums)


def _receiver(bit: int, bits: int) -> Column:
    """Level of the ancestor at distance 2**bit."""
    depth = F.col("depth") - (1 << bit)
    return F.when(depth == 0, bits).otherwise(_level(depth)).alias("receiver")


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def ends_digests(convs: DataFrame, bits: int, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(name, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending, comma-joined.

    Ids are joined in chunks of neighbouring ids first, so a node at which a third of all conversations
    end is many rows of bounded length; its digest reads them in order and keeps none.
    """
    ends = convs.select(_end_name(bits).alias("name"), "conv_id", F.shiftright("conv_id", chunk_bits).alias("chunk"))
    chunks = ends.groupBy("name", "chunk").agg(F.array_sort(F.collect_list("conv_id")).alias("ids")).select("name", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = chunks.repartition("name").sortWithinPartitions("name", "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running = None, None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for key, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if key != name:
                    if name is not None:
                        out.append((name, running.hexdigest()))
                    name, running = key, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out])], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([running.hexdigest()])], ["name", "ends_sha256"])

    return ordered.mapInArrow(digest, "name binary, ends_sha256 string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``convs`` (conv_id: unique, seq as ``sequences`` gives it).

    Each distinct sequence of first d turns is a node, from the root without turns. Returns name, parent (null: root),
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree), saved_bytes
    (over its subtree, the bytes of each node's text that all members but one repeat) and ends_sha256 (of the ids of
    the conversations that end there). Subtrees include their top. Conversations without turns end at
    the root. No conversations give no nodes. Digests of 128 bits stand for turns and prefixes.
    """
    prepare(convs.sparkSession)
    convs = materialise(convs.select("conv_id", "seq"), "sequences")
    bits = _depth_bits(convs)
    inner = nodes_of(convs, bits)
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("binary").alias("above"), F.lit(0).alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes")
    )
    nodes = materialise(inner.unionByName(root), "nodes")
    children = materialise(nodes.where("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    own = nodes.join(children, "name", "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
            "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
            "saved_bytes": (F.col("n_convs") - 1) * F.col("bytes"),
        }
    )
    own = materialise(own, "own")
    below = graft(own, bits, ["n_leaves", "saved_bytes"]).withColumnsRenamed({"n_leaves": "leaves_below", "saved_bytes": "saved_below"})
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = own.join(below, "name", "left").join(ends_digests(convs, bits), "name", "left").join(above, "parent", "left")
    return found.select(
        "name",
        "parent",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("saved_bytes") + F.coalesce("saved_below", F.lit(0))).alias("saved_bytes"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
