"""Hard-negative mining by threshold joins over inner products, in blocks.

Rows lie in blocks of 2,048, anchors in blocks of 512; every pair of blocks is one row of an equi-join and
is compared in one task. In a block of rows dimensions are in a common order, the heaviest first, and each row is
indexed only up to the dimension from which the norm of what is left, times that of the anchors, stays below the lowest
threshold. Scores are summed over the index a few dimensions at a time; a pair is given up as soon as
its sum and the product of the remaining norms are below its threshold, and what is left out of
the index is added for the pairs that survive. A pass returns every pair at or above the thresholds it was
given; thresholds are lowered, for the anchors alone whose windows are not full, until all are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.batches import arrow_session
from tillwatch.session import materialise

#: Rows and anchors in a block, and dimensions whose scores are summed between two looks at the bounds.
ROW_BLOCK, ANCHOR_BLOCK, DIMENSIONS = 2048, 512, 16
#: Thresholds for positives as shares of the largest score possible; the last pass has none.
SHARES = (0.4, 0.2, 0.1)
#: Of a window, the share from its top that the first passes for negatives look at; the last looks at all.
DEPTHS = (0.125, 0.5, 1.0)
#: Components are rounded down to multiples of 1/SCALE.
SCALE = 256
#: Squared norms beyond it could give scores that are no longs.
LARGEST = 2.0**62

BLOCK = "block long, ids array<long>, labels array<long>, width long, data binary"
LOWEST = -(2**62) - 1


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    data: np.ndarray  # rows x dimensions


def quantised(vectors: DataFrame, vec_id: str, label: Column, embedding: str) -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that take part; one row for each vec_id."""
    vector = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE))
    sound = ~F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= 2.0**54))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & sound).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where(F.col("label").isNotNull() & (norm <= LARGEST))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: list, width: int, block: int) -> pa.RecordBatch:
    data = np.zeros((len(ids), width), "<i8")
    for at, v in enumerate(vectors):
        data[at, : len(v)] = v
    row = {"block": block, "ids": ids, "labels": labels, "width": width, "data": data.tobytes()}
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in zip(row, kinds)], list(row))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of ``quantised`` packed into blocks of ``size`` rows at most; written, so that numbers of blocks hold."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def flush() -> pa.RecordBatch:
            vectors = [v for _, _, v in held]
            return _packed(np.array([i for i, _, _ in held]), np.array([c for _, c, _ in held]), vectors, max(map(len, vectors)), number)

        for batch in batches:
            vectors = batch.column("vector")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            for i, c, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), np.split(flat, ends[:-1])):
                held.append((i, c, v))
                if len(held) == size:
                    yield flush()
                    number, held = number + 1, []
        if held:
            yield flush()

    arrow_session(rows.sparkSession)
    return materialise(rows.select("vec_id", "label", "vector").mapInArrow(pack, BLOCK), "blocks")


def weights(rows: DataFrame) -> list[float]:
    """Sum of squares of each dimension."""
    each = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("w")).collect()
    found = {r.d: r.w for r in each}
    return [found[d] for d in range(len(found))]


def unpack(ids: list, labels: list, width: int, data: bytes, order: np.ndarray) -> Block:
    """Dimensions in the common order; a block narrower than that has zeros at the end."""
    found = np.zeros((len(ids), len(order)), np.int64)
    found[:, :width] = np.frombuffer(data, "<i8").reshape(len(ids), width)
    return Block(np.array(ids, np.int64), np.array(labels, np.int64), found[:, order])


def suffix_norms(data: np.ndarray) -> np.ndarray:
    """Norms of what is left from each dimension on; one more column, of zeros."""
    squares = data.astype(np.float64) ** 2
    out = np.zeros((len(data), data.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out * (1 + 1e-9)


def threshold_join(rows: np.ndarray, anchors: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose inner product is at least ``low`` of the anchor.

    Products of whole numbers are summed as floats where the norms prove that exact, as longs otherwise.
    """
    row_rest, anchor_rest = suffix_norms(rows), suffix_norms(anchors)
    kind = np.float64 if row_rest[:, 0].max(initial=0) * anchor_rest[:, 0].max(initial=0) < 2.0**52 else np.int64
    slack = low.astype(np.float64) - np.abs(low) * 1e-9 - 1
    # A row's index ends where the rest alone cannot reach the threshold of any anchor.
    cut = (row_rest * anchor_rest.max(0)[None, :] >= max(slack.min(), 1.0)).sum(1)
    row = np.argsort(-cut, kind="stable")  # so the rows listed for a dimension are the first ones
    cut, row_rest, q = cut[row], row_rest[row], anchors.astype(kind)
    whole = rows[row].astype(kind)
    indexed = np.where(np.arange(rows.shape[1])[None, :] < cut[:, None], whole, 0).astype(kind, copy=False)
    scores = np.zeros((len(anchors), len(row)), kind)

    def reachable(upto: int) -> np.ndarray:
        at = np.minimum(cut, upto)
        return scores + anchor_rest[:, at] * row_rest[np.arange(len(at)), at][None, :] >= slack[:, None]

    for begin in range(0, rows.shape[1], DIMENSIONS):
        listed = int((cut > begin).sum())
        if not listed:
            break
        end = min(begin + DIMENSIONS, rows.shape[1])
        scores[:, :listed] += q[:, begin:end] @ indexed[:listed, begin:end].T
        alive = reachable(end).any(0)
        if alive.sum() < 0.7 * len(alive):
            row, cut, row_rest, whole, indexed, scores = row[alive], cut[alive], row_rest[alive], whole[alive], indexed[alive], scores[:, alive]
    a, r = np.nonzero(reachable(rows.shape[1]))
    score = scores[a, r]
    # What the index omits is added for the pairs that are left, some at a time.
    left = np.flatnonzero(cut[r] < rows.shape[1])
    step = max(1, (1 << 20) // max(rows.shape[1], 1))
    for i in range(0, len(left), step):
        k = left[i : i + step]
        score[k] += np.einsum("ij,ij->i", whole[r[k]] - indexed[r[k]], q[a[k]])
    score = score.astype(np.int64)
    kept = score >= low[a]
    return a[kept], row[r[kept]], score[kept]


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first n of each group, by score (highest first) and id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    return order[place < n]


WINDOWS = "array<struct<positive_id: bigint, positive_score: bigint, low: bigint, high: bigint>>"


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Anchors (vec_id, label, vector, low, windows) packed: part (number of the block) and block."""
    many = anchors.count()
    rows = anchors.repartition(max(1, -(-many // ANCHOR_BLOCK)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches).to_pylist() if (batches := list(batches)) else []
        for i in range(0, len(found), ANCHOR_BLOCK):
            part = found[i : i + ANCHOR_BLOCK]
            block = _packed(np.array([r["vec_id"] for r in part]), np.array([r["label"] for r in part]), [r["vector"] for r in part], max(len(r["vector"]) for r in part), 0)
            more = {"lows": [r["low"] for r in part], "windows": [[at, *w.values()] for at, r in enumerate(part) for w in r["windows"] or []]}
            arrays = [pa.array([more["lows"]], pa.list_(pa.int64())), pa.array([more["windows"]], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*block.columns[1:], *arrays], ["a_ids", "a_labels", "a_width", "a_data", *more])

    schema = "a_ids array<long>, a_labels array<long>, a_width long, a_data binary, lows array<long>, windows array<array<long>>"
    return materialise(rows.mapInArrow(pack, schema), "anchors")


def compare(rows: DataFrame, anchors: DataFrame, order: list[int], schema: str, pick: Callable) -> DataFrame:
    """What ``pick(rows, anchors, pairs, windows)`` gives for every block of rows and block of anchors.

    Each block of anchors is copied to as many shards as there are blocks of rows, which are dealt over the shards by hash.
    The copies are never broadcast, whatever size Spark takes them for (it does not count them): they are merged by
    shard, one after the other, with the few blocks of rows of the shard held.
    """
    shards = max(1, rows.count())
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    copies = anchor_blocks(anchors).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    ordered = np.array(order, np.int64)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = unpack(r["ids"], r["labels"], r["width"], r["data"], ordered)
                own = unpack(r["a_ids"], r["a_labels"], r["a_width"], r["a_data"], ordered)
                pairs = threshold_join(block.data, own.data, np.array(r["lows"], np.int64))
                found = pick(block, own, pairs, np.array(r["windows"], np.int64).reshape(-1, 5))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

    return copies.hint("merge").join(dealt, "shard").drop("shard", "block").mapInArrow(run, schema)


def pick_positives(n: int) -> Callable:
    def pick(rows: Block, anchors: Block, pairs: tuple, windows: np.ndarray) -> list[np.ndarray]:
        a, r, score = pairs
        other = (rows.labels[r] == anchors.labels[a]) & (rows.ids[r] != anchors.ids[a])
        a, r, score = a[other], r[other], score[other]
        first = first_of_each(a, score, rows.ids[r], n)
        return [anchors.ids[a[first]], rows.ids[r[first]], score[first]]

    return pick


def pick_negatives(n: int) -> Callable:
    def pick(rows: Block, anchors: Block, pairs: tuple, windows: np.ndarray) -> list[np.ndarray]:
        a, r, score = pairs
        other = rows.labels[r] != anchors.labels[a]
        a, r, score = a[other], r[other], score[other]
        begin, end = np.searchsorted(a, windows[:, 0]), np.searchsorted(a, windows[:, 0], "right")
        found = []
        for (at, positive, positive_score, low, high), i, j in zip(windows.tolist(), begin, end):
            inside = i + np.flatnonzero((score[i:j] >= low) & (score[i:j] <= high))
            first = inside[first_of_each(np.zeros(len(inside)), score[inside], rows.ids[r[inside]], n)]
            found.append(np.stack([np.full(len(first), anchors.ids[at]), np.full(len(first), positive), np.full(len(first), positive_score), rows.ids[r[first]], score[first]]))
        return list(np.concatenate(found, axis=1)) if found else [np.zeros(0, np.int64)] * 5

    return pick


def _ranked(found: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def positives(rows: DataFrame, anchors: DataFrame, order: list[int], largest: float, n: int) -> DataFrame:
    """(vec_id, positive_id, positive_score) of the first n other rows of each anchor's label."""
    own_norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    pending, done = anchors.withColumn("windows", F.array().cast(WINDOWS)), None
    for share in (*SHARES, None):
        low = F.lit(LOWEST) if share is None else F.floor(own_norm * largest * share)
        found = compare(rows, pending.withColumn("low", low), order, "vec_id long, positive_id long, positive_score long", pick_positives(n))
        found = materialise(_ranked(found, ["vec_id"], "positive_score", "positive_id", n).drop("rank"), "positives")
        full = found.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (n if share is not None else 0)).select("vec_id")
        found = found.join(full, "vec_id", "left_semi")
        done = found if done is None else done.unionByName(found)
        pending = materialise(pending.join(full, "vec_id", "left_anti"), "pending")
        if share is None or pending.isEmpty():
            return done


def negatives(rows: DataFrame, windows: DataFrame, anchors: DataFrame, order: list[int], n: int) -> DataFrame:
    """Rows of another label in each window (vec_id, positive_id, positive_score, low, high), the first n."""
    key = ["vec_id", "positive_id"]
    pending, done = windows, None
    for depth in DEPTHS:
        look = pending.withColumn("low", F.col("high") - F.floor((F.col("high") - F.col("low")) * F.lit(depth)).cast("long") if depth < 1 else F.col("low"))
        listed = look.groupBy("vec_id").agg(F.min("low").alias("low"), F.collect_list(F.struct("positive_id", "positive_score", "low", "high")).alias("windows"))
        found = compare(rows, anchors.hint("merge").join(listed, "vec_id"), order, "vec_id long, positive_id long, positive_score long, negative_id long, negative_score long", pick_negatives(n))
        found = materialise(_ranked(found, key, "negative_score", "negative_id", n), "negatives")
        full = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (n if depth < 1 else 0)).select(*key)
        found = found.join(full, key, "left_semi")
        done = found if done is None else done.unionByName(found)
        pending = materialise(pending.join(full, key, "left_anti"), "pending")
        if pending.isEmpty():
            break
    return done


def mine(
    vectors: DataFrame,
    anchor: Column,
    label: Column | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its inner product with the anchor, of components rounded down to multiples of 1/256 (times 256, so whole numbers). Anchors
    are the rows for which ``anchor`` (of vec_id) holds; an anchor's positives are the first ``n_positives`` other rows of its label (``label``, by
    default the column label), by score, ties by vec_id; its negatives for a positive are the first ``n_negatives`` rows of other
    labels whose score is between ``low_percent`` and ``high_percent`` of the positive's. A positive of a score below zero has none.

    Rows with a null id, label, vector or component, or one that is not finite, take no part, nor do vectors so long that a score could exceed a
    long. Of rows with the same id the one with the smallest label and vector counts. Vectors of different lengths
    are compared over what both have. Equal vectors are ties like any others. An empty table gives no rows.
    """
    arrow_session(vectors.sparkSession)
    plain = materialise(quantised(vectors, vec_id, F.col("label") if label is None else label, embedding), "vectors")
    each = weights(plain)
    order = [d for d, _ in sorted(enumerate(each), key=lambda w: -w[1])]
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = plain.agg(F.sqrt(F.max(squares))).first()[0] or 0.0
    rows = blocks(plain, ROW_BLOCK)
    anchors = materialise(plain.where(anchor).select("vec_id", "label", "vector"), "anchor-rows")
    best = positives(rows, anchors, order, largest, n_positives)
    exact = "cast(positive_score as decimal(20,0))"
    windows = best.where("positive_score >= 0").withColumns(
        {"low": F.expr(f"({exact} * {low_percent} + 99) div 100"), "high": F.expr(f"({exact} * {high_percent}) div 100")}
    )
    found = negatives(rows, materialise(windows, "windows"), anchors, order, n_negatives)
    return found.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
