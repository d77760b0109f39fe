"""Searches of many queries against all products."""

import numpy as np
import pytest

from talentspark.operators import vector_index

NAN = float("nan")


def clustered(n=800, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, dims))[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, x, every=20):
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(x)]
    odd = [(10_000, None, "x"), (10_020, [NAN] * x.shape[1], "x"), (10_040, [1.0], "x"), (10_060, [], "x")]
    v = spark.createDataFrame(rows + odd, "id long, v array<double>, cell2 string").repartition(4)
    return v, v.where(f"id % {every} = 0").selectExpr("id AS query_id", "v AS q")


def plain(x, k, every=20):
    s = np.round(x @ x.T, 9)
    out = {}
    for q in range(0, len(x), every):
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[q, i], i))[:k]
        out[q] = order
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_nearest(spark, block):
    x = clustered(300)
    v, q = frames(spark, x)
    assert lists(vector_index.nearest(q, v, 5, block=block)) == plain(x, 5)
    pairs = {(r["query_id"], r["id"]) for r in vector_index.reaching(q, v, 0.8, block=block).collect()}
    s = x @ x.T
    assert pairs == {(a, b) for a in range(0, 300, 20) for b in range(300) if a != b and s[a, b] >= 0.8}


def test_ties_and_empty(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "id long, v array<double>")
    q = v.where("id = 7").selectExpr("id AS query_id", "v AS q")
    assert lists(vector_index.nearest(q, v, 3)) == {7: [0, 1, 2]}
    none = v.where("false")
    assert vector_index.nearest(q.where("false"), v, 3).count() == 0 and vector_index.nearest(q, none, 3).count() == 0
    index = vector_index.build(none)
    assert vector_index.search(index, q, 3, 1).count() == 0
    # All vectors are one point: one cell, and that is exact.
    index = vector_index.build(v, cells=8)
    assert len(index.centres) == 1 and lists(vector_index.search(index, q, 3, 1)) == {7: [0, 1, 2]}


def test_inverted_file(spark):
    x = clustered()
    v, q = frames(spark, x)
    index = vector_index.build(v, cells=20)
    assert index.table.count() == len(x) and set(index.table.columns) == {"id", "v", "cell2", "cell"}
    want = plain(x, 5)
    assert lists(vector_index.search(index, q, 5, probes=20)) == want
    probes = vector_index.plan_probes(index, q, 5, recall=0.95)
    found = lists(vector_index.search(index, q, 5, probes))
    recall = np.mean([len(set(found[i]) & set(want[i])) / 5 for i in want])
    assert recall >= 0.9 and probes < 12
