"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("talentspark.llm")
from talentspark.llm import exact_topk  # noqa: E402

INF, NAN = float("inf"), float("nan")


def brute(rows, k=20, scale=64, every=20):
    own = []
    for i, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            own.append((i, [math.floor(scale * float(c)) for c in x]))
    out = []
    for n, (q, x) in enumerate(own):
        if q is None or q % every:
            continue
        found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c is None, c or 0, m, c) for m, (c, y) in enumerate(own) if m != n and len(x) == len(y)]
        out += [(q, rank, f[4], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], f"vec_id long, embedding array<{kind}>, score int").repartition(5)
    return sorted(map(tuple, exact_topk.search(df, F.col("vec_id") % 20 == 0, **more).collect()), key=str)


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(120)]
    rows += [(200, None), (220, [1.0, None] * 4), (240, [NAN] * 8), (260, [INF] * 8), (280, [0.0] * 8), (300, []), (320, []), (340, [1.0, 2.0]), (360, [2.0, 2.0]), (380, [5.0])]
    rows += [(20, rows[20][1]), (None, rows[40][1]), (41, rows[40][1]), (43, rows[40][1])]
    assert searched(spark, rows) == brute(rows)
    assert searched(spark, rows, k=3, block=40, seeds=7) == brute(rows, k=3)
    assert searched(spark, []) == [] and searched(spark, [(1, [1.0])]) == [] and searched(spark, [(0, [1.0])]) == []


def test_large_numbers(spark):
    rows = [(0, [1e14, 3.0]), (1, [1e14, -7.0]), (2, [-1e14, 1.0]), (3, [1e300, 1.0]), (4, [0.5, 2.0**40 + 1]), (20, [2.0**45 + 1, 2.0**30 + 1]), (6, [1.7e308, 0.0])]
    assert searched(spark, rows, "double", k=4) == brute(rows[:-1], k=4)


def test_groups_of_copies(spark):
    """Clustered vectors with many ties; bounds cut most pairs off and lose none."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(v) for v in centres[i % 12] + (0.02 * rng.normal(size=64) if i % 3 else 0)]) for i in range(900)]
    assert searched(spark, rows, "double", seeds=64) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(64 * (rng.normal(size=(20, 1, 64)) + 0.1 * rng.normal(size=(20, 40, 64)))).reshape(800, 64)
    q = exact_topk.Queries(np.arange(40), x[::20].copy())
    score = q.x @ x.T
    reach = np.sort(score, axis=1)[:, -20].astype(float)
    kept = {(i, int(j)) for i, near in q.survivors(x, reach) for j in near}
    assert {(i, j) for i, j in zip(*np.nonzero(score >= reach[:, None]))} <= kept
    assert len(kept) < 0.15 * score.size
