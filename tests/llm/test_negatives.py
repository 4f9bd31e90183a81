import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, modulus, n=5):
    kept = {}
    for i, v, c in rows:
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(i, []).append((c, [math.floor(256 * float(np.float32(x))) for x in v]))
    kept = {i: min(found) for i, found in kept.items()}
    out = []
    for a, (label, vector) in kept.items():
        if a % modulus:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), i, c) for i, (c, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:n]:
            window = [(-t, i) for t, i, c in scores if c != label and 80 * -s <= 100 * -t <= 100 * -s][:n]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(window, 1)]
    return sorted(out)


def drawn(n, width, seed, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[draw.integers(6)] + draw.normal(size=width) * draw.choice([0.2, 1.0])
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], int(draw.integers(labels))))
    return rows


def mined(df, modulus, **options):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % modulus == 0, **options).collect())


def test_against_all_pairs_in_small_blocks(spark, monkeypatch):
    rows = drawn(300, 20, 1)
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(60)]  # copies: ties by id
    monkeypatch.setattr(negatives, "ROW_BLOCK", 37)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 7)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = brute(rows, 20)
    assert len(want) > 200 and mined(df, 20) == want


def test_rows_that_take_no_part_and_extra_columns(spark):
    rows = drawn(80, 8, 2)
    odd = [(100, None, 1), (102, [0.5, None], 1), (104, [float("nan")] * 8, 1), (106, [float("inf")] * 8, 0), (108, [0.1] * 8, None), (None, [0.5] * 8, 1), (110, [], 1), (112, [0.9], 2), (114, [0.1] * 12, 2)]
    rows += odd + rows[:7] + [(3, [0.3] * 8, 0), (116, [0.0] * 8, 0), (118, [1e15] * 8, 1)]
    want = brute([r for r in rows if r[0] != 118], 2)
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], VECTORS + ", data binary, block int").repartition(2)
    assert mined(df, 2) == want
    assert mined(df.limit(0), 2) == []
    assert mined(df.where("vec_id = 4"), 2) == []


def test_fewer_rows_than_windows_hold(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.45, 0.0], 1), (3, [-1.0, 0.0], 0), (4, [0.5, 0.0], 1), (5, [0.51, 0.0], 1), (6, [0.39, 0.0], 1)]
    got = mined(spark.createDataFrame(rows, VECTORS), 100)
    assert got == brute(rows, 100) and [r[3] for r in got] == [4, 2]


@pytest.mark.parametrize("scale", [1, 2**22])
def test_threshold_join_keeps_every_pair(scale):
    draw = np.random.default_rng(4)
    rows, anchors = (draw.normal(size=(n, 50)) * 60 * scale * 0.9 ** np.arange(50)[None, :] for n in (400, 30))
    rows, anchors = np.floor(rows).astype(np.int64), np.floor(anchors).astype(np.int64)
    scores = anchors @ rows.T
    for share in (0.999, 0.9, 0.5):
        low = np.quantile(scores, share, axis=1).astype(np.int64)
        low[0] = negatives.LOWEST if share == 0.5 else low[0]
        a, r, score = negatives.threshold_join(rows, anchors, low)
        want = {(i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= low[:, None]))}
        assert set(zip(a.tolist(), r.tolist(), score.tolist())) == want and len(a) == len(want)


def test_rows_that_no_threshold_can_reach_are_not_indexed():
    rows = np.vstack([np.full((5, 8), 1), np.full((5, 8), 100)])
    anchors = np.full((2, 8), 100)
    a, r, _ = negatives.threshold_join(rows, anchors, np.array([50_000, 90_000]))
    assert set(r.tolist()) == {5, 6, 7, 8, 9} and set(a.tolist()) == {0}


def test_copies_of_anchors_are_not_broadcast(spark):
    rows = negatives.quantised(spark.createDataFrame(drawn(40, 8, 3), VECTORS), "vec_id", F.col("label"), "embedding")
    anchors = rows.withColumn("low", F.lit(0).cast("long")).withColumn("windows", F.array().cast(negatives.WINDOWS))
    found = negatives.compare(negatives.blocks(rows, 8), anchors, list(range(8)), "vec_id long, positive_id long, positive_score long", negatives.pick_positives(5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
