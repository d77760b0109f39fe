"""Distributed communities against the sequential form and planted groups."""

import random

from pyspark.sql import functions as F

from talentspark.operators import communities, graph


def quality(edges, home):
    m = sum(w for *_, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        for n in (a, b):
            degree[home[n]] = degree.get(home[n], 0) + w
        if home[a] == home[b]:
            inside[home[a]] = inside.get(home[a], 0) + w
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def planted(groups, size, rng, far):
    edges = [(f"g{g:02}n{i}", f"g{g:02}n{j}", 2.0) for g in range(groups) for i in range(size) for j in range(i)]
    return edges + [(f"g{rng.randrange(groups):02}n{rng.randrange(size)}", f"g{rng.randrange(groups):02}n{rng.randrange(size)}", 1.0) for _ in range(far)]


def found(spark, edges):
    return {r["node"]: r["community"] for r in communities.communities(spark.createDataFrame(edges, "src string, dst string, weight double").repartition(3)).collect()}


def test_planted_groups(spark):
    edges = planted(8, 6, random.Random(1), 12)
    assert found(spark, edges) == {n: n[:3] + "n0" for e in edges for n in e[:2]}


def test_near_the_sequential_form(spark):
    rng = random.Random(2)
    edges = planted(5, 5, rng, 60)
    home = found(spark, edges)
    one = graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double").withColumn("graph", F.lit("g"))).collect()
    assert quality(edges, home) >= quality(edges, {r["node"]: r["community"] for r in one}) - 0.03


def test_loops_hubs_and_empty(spark):
    assert found(spark, []) == {}
    assert found(spark, [("a", "a", 1.0), ("b", "c", 1.0), ("b", "c", 1.0), (None, "c", 1.0), ("x", "y", 0.0)]) == {"a": "a", "b": "b", "c": "b"}
    assert found(spark, [("hub", f"n{i}", 1.0) for i in range(12)]) == {n: "hub" for n in ("hub", *(f"n{i}" for i in range(12)))}


def test_groups_as_pairs(spark):
    """Groups give the communities of their listed pairs; nodes in two groups or with edges of their own, loops and lone members included."""
    groups = {g: [f"{g}{i:02}" for i in range(n)] for g, n in (("a", 9), ("b", 7), ("c", 2), ("d", 1), ("e", 12))}
    groups["b"].append("a00")
    edges = [("a03", "b04", 1.0), ("c00", "e02", 0.5), ("e05", "e05", 3.0), ("x", "y", 4.0), ("e01", None, 1.0), ("b01", "c01", 0.0)]
    pairs = [(m, n, 2.0) for own in groups.values() for m in own for n in own if m < n]
    table, schema = spark.createDataFrame(edges, "src string, dst string, weight double"), "node string, group string"
    members = spark.createDataFrame([(n, g) for g, own in groups.items() for n in own for _ in range(2)] + [(None, "a"), ("b00", None)], schema)
    got = communities.communities(table, groups=members, weight=2.0).collect()
    want = found(spark, edges + pairs)
    assert {r["node"]: r["community"] for r in got} == want and len(got) == len(want)
    # The rows of a large group do not grow with its pairs, the weights of its pairs are all there.
    large = spark.range(3000).selectExpr("cast(id as string) node", "'g' group")
    few, twins = communities.contracted(spark.createDataFrame([("7", "z", 1.0)], "src string, dst string, weight double"), large, 2.0)
    assert few.count() == 3 and few.agg(F.sum("weight")).first()[0] == 3000 * 2999 + 1 and twins.count() == 2999
