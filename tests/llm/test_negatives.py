"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import op13_negatives


def brute(rows, positives=5, k=3, scale=256):
    """Rows (id, vector, label) with anchors at ids divisible by 5."""
    whole = [(i, [math.floor(scale * float(x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, y in whole:
        if i % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for j, v, z in whole if j != i and len(v) == len(q))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:k]
            out += [(i, j, n + 1, c, -s, -t) for n, (t, c, _) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(0)).withColumn("dim", F.lit("x"))
    got = op13_negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0, F.col("label"), **how)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("shard,leaf", [(16_384, 256), (60, 4), (25, 1)])
def test_negatives(spark, shard, leaf):
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x * 0.3 + rng.gauss(0, 0.1) for x in middle[rng.randrange(5)]], rng.randrange(3)) for i in range(200)]
    rows += [(300 + i, [0.5] * 6, i % 2) for i in range(60)]  # one common vector
    rows += [(400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 1), (405, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    rows += [(500, [0.0] * 6, 0), (505, [-1.0] * 6, 7), (510, [0.4, 0.2], 0), (511, [0.4, 0.2], 0), (512, [0.3, 0.1], 1), (515, [], 0), (516, [], 0), (517, [], 1)]
    assert mined(spark, rows, shard=shard, leaf=leaf) == brute(rows)


def test_huge_scores(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-(10**6), 10**6) * 1.0 for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows, shard=30, leaf=4) == brute(rows)


def test_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.1], 0), (2, [0.1], 1)]) == []


def test_leaves_are_passed_over():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 3)) * 300
    v = centres[np.arange(4_000) % 40] + rng.normal(size=(4_000, 3)) * 5
    v = np.floor(v / np.linalg.norm(v, axis=1)[:, None] * 300)
    radius2 = float((v * v).sum(axis=1).max())
    at, nodes = op13_negatives.build(v, radius2, 32)
    order = np.argsort(at, kind="stable")
    tree = {"v": v[order], "ids": order, "labels": order % 3, "cuts": np.searchsorted(at[order], np.arange(at.max() + 2)), "vantage": v[[p for p, _ in nodes]], "ranges": np.array([r for _, r in nodes]), "radius2": radius2}
    q = v[:50]
    top, least = op13_negatives.bounds(q, tree["vantage"], tree["ranges"], radius2)
    score = q @ v.T
    assert (top[:, at] >= score).all() and (least[:, at] <= score).all()
    own = np.arange(50)
    low, visited = np.full(50, -(2**40)), []
    for high in (((q * q).sum(axis=1) * 0.95).astype(np.int64), np.full(50, 2**40)):
        win, ids, got, visits = op13_negatives.search(tree, q, own, own, own % 3, low, high, False, 3)
        visited.append(visits / 50 / (at.max() + 1))
        for w in range(50):
            want = sorted((-s, i) for i, s in enumerate(score[w]) if i % 3 != w % 3 and s <= high[w])[:3]
            assert [(-s, i) for i, s in zip(ids[win == w], got[win == w], strict=True)] == want
    assert visited[0] < 0.75 and visited[1] < 0.25
