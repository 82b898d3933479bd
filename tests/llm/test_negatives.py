"""Hard negatives beside all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import negatives

COLUMNS = "vec_id long, label int, embedding array<float>, ord string, score int, chunk string"


def expected(rows, every=100, low=30, high=90, n_positive=5, n_negative=10):
    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(dot(v, w), i, other) for j, (i, other, w) in enumerate(rows) if j != k]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=rank)[:n_positive]:
            fits = sorted((s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=rank)
            out += [(a, p, r, i, ps, s) for r, (s, i, _) in enumerate(fits[:n_negative], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **small):
    df = spark.createDataFrame([(*r, None, 1, "x") for r in rows], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in negatives.mine(negatives.usable(df), F.col("vec_id") % 100 == 0, **small).collect()), key=str)


def clustered(seed, n, width, spread=0.4, lengths=(1, 1)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    out = []
    for i in range(n):
        label = int(rng.integers(6))
        v = centres[label if rng.random() < 0.8 else rng.integers(6)] + spread * rng.normal(size=width)
        out.append((i, label, [float(np.float32(x)) for x in v / np.linalg.norm(v) * rng.uniform(*lengths)]))
    return out


@pytest.mark.parametrize("lengths", [(1, 1), (0.1, 3)])
def test_many_buckets_stripes_and_blocks(spark, lengths):
    rows = clustered(3, 700, 12, lengths=lengths)
    got = mined(spark, rows, stripe_rows=150, bucket_rows=40, block_anchors=3)
    assert got == expected(rows) and len(got) > 50
    assert got == mined(spark, rows)


def test_odd_rows(spark):
    rows = [*clustered(4, 320, 6), (None, 1, [0.5] * 6), (400, 1, None), (401, None, [0.5] * 6), (402, 2, [0.5, None, 0.1]), (403, 2, [float("nan"), 0.1]), (404, 2, [float("inf"), 0.1]),
            (500, 2, []), (600, 3, [0.0] * 6), (700, 3, [0.4, -0.2, 0.1, 0.9]), (800, 1, [30.0, -20.0, 10.0, 5.0, 1.0, 0.5]), (900, 4, [5000.0, 4000.0, 1.0, 2.0, 3.0, 4.0]), (901, 4, [4000.0, 5000.0]), (902, 5, [3000.0, 2000.0])]
    got = mined(spark, rows, stripe_rows=100, bucket_rows=30)
    assert got == expected(rows) and {r[0] for r in got} >= {0, 100, 500, 600, 700, 900} and 400 not in {r[0] for r in got}


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(8)
    rows = [(i, i % 2, [float(np.float32(r.uniform(0.5, 1) * 2**21)) for _ in range(5)]) for i in range(120)]
    assert mined(spark, rows, bucket_rows=16, stripe_rows=50) == expected(rows)


def test_many_equal_vectors(spark):
    """Copies of one vector hold a third of the rows; ties go by id."""
    rows = clustered(5, 400, 8)
    rows = [(i, i % 5 if i % 3 == 0 else l, rows[0][2] if i % 3 == 0 else v) for i, l, v in rows]
    assert mined(spark, rows, stripe_rows=90, bucket_rows=25) == expected(rows)


def test_repeated_rows(spark):
    """Of equal rows with one id, each is an anchor, a positive of the other, and a negative."""
    rows = [(0, 1, [1.0, 0.0])] * 2 + [(1, 2, [0.8, 0.1]), (1, 2, [0.8, 0.1]), (2, 1, [0.9, 0.0])]
    assert mined(spark, rows) == expected(rows)


def test_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, 1, [1.0])]) == []


def test_pruning_leaves_out_rows_but_no_answers(spark):
    """Lists are cut where the wanted score is high, and every row that reaches it is left."""
    rng = np.random.default_rng(2)
    q = rng.normal(size=(2000, 5)) * 100
    rows = negatives.Rows(np.arange(2000), np.arange(2000), np.zeros(2000, int), q.astype(np.int64))
    bucket = negatives.Bucket(rows, np.float64)
    a = rows.q[7].astype(float)
    length = np.linalg.norm(a)
    score = rows.q @ rows.q[7]
    left = []
    for wanted in (0.2, 0.5, 0.8, 0.95):
        limit = wanted * length * bucket.longest
        at = bucket.feasible(a / length, length, np.argsort(-np.abs(a))[:4], limit)
        found = np.arange(2000)[at]
        assert set(np.flatnonzero(score >= limit)) <= set(found.tolist())
        left.append(len(found))
    assert left == sorted(left, reverse=True) and left[-1] < 100
    assert len(bucket.feasible(a / length, length, np.arange(4), 1.01 * length * bucket.longest)) == 0
