"""Hard negatives against a brute force over all pairs."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import hard_negatives as H

KIND = "vec_id long, embedding array<double>, label long"


def brute(rows, every, positives=5, negatives=3):
    """Rows are (id, vector, label); of several anchor rows with one id the least (label, vector) asks."""
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(Fraction(x) * 256) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    asks = {}
    for i, label, v in own:
        if i % every == 0:
            asks[i] = min(asks.get(i, (label, v)), (label, v))
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for i, (label, v) in asks.items():
        others = [(-dot(v, w), j, kind) for j, kind, w in own if j != i]
        for ps, p in sorted((s, j) for s, j, kind in others if kind == label)[:positives]:
            fit = sorted((s, j) for s, j, kind in others if kind != label and 50 * -ps <= 100 * -s <= 95 * -ps)[:negatives]
            out += [(i, p, r + 1, j, clip(-ps), clip(-s)) for r, (s, j) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, every, clash=True):
    df = spark.createDataFrame(rows, KIND).repartition(4)
    if clash:
        df = df.withColumns({c: F.lit(-1) for c in ("v", "norm", "band", "g", "given", "score", "rank", "anchor_id", "needs")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.hard_negatives(H.labelled_vectors(df, label), F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("BUCKET", 60), ("ANCHORS", 4), ("STEP", 16), ("SEEDS", 20)):
            monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * int(rng.integers(1, 4)) for x in (rng.integers(-2, 4, 8) if i % 3 else [1, 1, 0, 0, 0, 0, 0, 1])], int(rng.integers(0, 3))) for i in range(500)]
    rows += [(1000, None, 1), (1010, [1.0, None], 1), (1020, [float("nan")] * 8, 2), (1030, [1.0] * 8, None), (None, [9.0] * 8, 1), (1040, [], 1), (1050, [0.0] * 8, 0), (1060, [float("inf")] * 8, 0)]
    rows += [(30, [3.0] * 8, 1), (30, [3.0] * 8, 1), (31, rows[31][1], rows[31][2])] + [(2000 + i, [2.0] * 8, i % 2) for i in range(200)]  # repeated rows, and many equal vectors
    want = brute(rows, 10)
    assert len(want) > 200 and got(spark, rows, 10) == want


@pytest.mark.parametrize("big", [1e5, 1e15, 5e37])
def test_vectors_of_any_length(spark, big):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(1, 1, 6) * (big if i % 5 == 0 else 1)], int(rng.integers(0, 3))) for i in range(150)]
    want = brute(rows, 10)
    assert want and got(spark, rows, 10) == want


def test_nothing_to_find(spark):
    rows = [(i, [1.0, 2.0], 4) for i in range(20) if i % 7]
    assert got(spark, rows, 10) == []  # one label
    assert got(spark, [(10, [1.0], 1)], 10) == [] and got(spark, [(11, [1.0], 1), (12, [1.0], 2)], 10) == []
    assert got(spark, rows[:0], 10) == []
    assert got(spark, [(10, [-1.0], 1), (11, [1.0], 1), (12, [0.6], 2), (13, [-0.6], 3)], 10) == []  # a negative positive has no window


def test_scores_stand_for_integers():
    for x in (0, 5, -7, 2**63 - 1, -(2**63), 2**63, -(2**63) - 1, 10**40, -(10**77)):
        score = H._integers([x])
        assert H.exact(int(H._as_long(score)[0]), H._beyond(score)[0]) == x
