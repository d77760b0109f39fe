"""Communities of a weighted graph by rounds of joins and aggregations, whatever the graph's size.

In a round, half of the nodes (a hash and the round decide which) look at the communities of their neighbours, whose
weights an aggregation adds up, and move to the one that gains most modularity; the others stay, so two nodes do not swap
places.  Once moves no longer raise the modularity, every community becomes one node and the rounds start again on the
smaller graph.  Edges never meet in one group, and each round's labels are a written table.

Groups whose members all know each other need not be listed as pairs.  Members of one group with no edge beyond it are
twins: linked with the weight w, and with equal neighbours and degrees k.  Of two twins in different communities one can
move to the other without loss, as that gains w - k * k / total beside what their neighbours give, and a group of n has
k = w * (n - 1) and a total of at least n * k, so k * k / total < w.  Twins therefore start as one node, with their
inner weight as its loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import written

_SMALL = 1e-9


def _symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) both ways, parallel edges added up; a loop counts twice, as it adds twice to its node's degree."""
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = e.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _quality(labelled: DataFrame, total: float) -> float:
    """Modularity of symmetric edges with the communities of both ends (c, d)."""
    inside = labelled.where("c = d").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("x")).first()["x"]
    degrees = labelled.groupBy("c").agg(F.sum("weight").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("x")).first()["x"]
    return inside / total - degrees / total**2


def _moved(both: DataFrame, labels: DataFrame, degrees: DataFrame, total: float, turn: int) -> DataFrame:
    """(node, community) after the nodes of this turn have moved."""
    there = labels.select(F.col("node").alias("dst"), F.col("community").alias("c"))
    into = both.where("src <> dst").join(there, "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("weight").alias("w"))
    now = labels.join(degrees, "node")
    sizes = now.groupBy(F.col("community").alias("c")).agg(F.sum("degree").alias("size"), F.count("*").alias("n"))
    # A node may also stay where none of its neighbours is.
    options = into.unionByName(labels.select("node", F.col("community").alias("c"), F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
    options = options.join(now, "node").join(sizes, "c")
    own = F.col("c") == F.col("community")
    rest = F.col("size") - F.when(own, F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("w") - rest * F.col("degree") / total, 9)
    best = options.groupBy("node").agg(F.min_by(F.struct("c", "n"), F.struct(-gain, (~own).alias("away"), F.col("c"))).alias("best"), F.max(F.when(own, F.col("n"))).alias("own"))
    # Of two that are alone only the one of the larger name goes to the other, so they do not swap names in one half.
    swaps = (F.col("own") == 1) & (F.col("best.n") == 1) & (F.col("best.c") > F.col("community"))
    moves = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
    return labels.join(best, "node").select("node", F.when(moves & ~swaps, F.col("best.c")).otherwise(F.col("community")).alias("community"))


def contracted(edges: DataFrame, groups: DataFrame, weight: float) -> tuple[DataFrame, DataFrame]:
    """(edges, twins) of edges(src, dst, weight) and all pairs of members of each of groups(node, group), linked with ``weight``.

    Twins are one node there, their smallest; twins(node, twin) says which.  Members with an edge of their own or in a
    second group are no twins and meet pair by pair.
    """
    usable = "src IS NOT NULL AND dst IS NOT NULL AND weight > 0"
    ends = edges.where(usable).select(F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("node")).distinct().withColumn("linked", F.lit(True))
    m = groups.where("node IS NOT NULL AND group IS NOT NULL").select(F.col("node").cast("string").alias("node"), "group").distinct()
    alone = m.groupBy("node").agg(F.count("*").alias("groups")).join(ends, "node", "left").select("node", (F.col("linked").isNull() & (F.col("groups") == 1)).alias("alone"))
    m = written(m.join(alone, "node"), "members")
    one = m.where("alone").groupBy("group").agg(F.min("node").alias("twin"), F.count("*").alias("n"))
    points = one.select("group", F.col("twin").alias("src"), "n").unionByName(m.where("NOT alone").select("group", F.col("node").alias("src"), F.lit(1).cast("long").alias("n")))
    pairs = points.join(points.select("group", F.col("src").alias("dst"), F.col("n").alias("n2")), "group").where("src < dst").select("src", "dst", (F.lit(weight) * F.col("n") * F.col("n2")).alias("weight"))
    loops = one.where("n > 1").select(F.col("twin").alias("src"), F.col("twin").alias("dst"), (F.lit(weight) * F.col("n") * (F.col("n") - 1) / 2).alias("weight"))
    return edges.select("src", "dst", "weight").unionByName(pairs).unionByName(loops), m.where("alone").join(one, "group").select("node", "twin")


def communities(edges: DataFrame, most_rounds: int = 16, most_levels: int = 10, groups: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """(node, community) of edges(src, dst, weight): each community is named by its smallest node.

    Directions are ignored, parallel edges add up, loops stay with their node; edges without an end or a positive weight
    are left out.  A level ends when both halves of a dealing do not raise the modularity; its best labels are kept.  Where groups(node,
    group) are given, all members of a group are linked with ``weight`` as well.
    """
    if groups is not None:
        edges, twins = contracted(edges, groups, weight)
        home = communities(edges, most_rounds, most_levels)
        return home.join(twins.withColumnRenamed("node", "member").withColumnRenamed("twin", "node"), "node", "left").select(F.coalesce("member", "node").alias("node"), "community")
    both = written(_symmetric(edges), "graph")
    total = both.agg(F.sum("weight").alias("x")).first()["x"]
    nodes = both.select(F.col("src").alias("node")).distinct()
    home = nodes.select("node", F.col("node").alias("community"))
    if total is None:
        return home
    for _ in range(most_levels):
        degrees = written(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")), "degrees")
        labels = best = written(degrees.select("node", F.col("node").alias("community")), "labels")

        def ends(found: DataFrame, both: DataFrame = both) -> DataFrame:
            c, d = (found.select(F.col("node").alias(end), F.col("community").alias(name)) for end, name in (("src", "c"), ("dst", "d")))
            return both.join(c, "src").join(d, "dst")

        start = most = _quality(ends(labels), total)
        worse = 0
        for turn in range(most_rounds):
            labels = written(_moved(both, labels, degrees, total, turn), "labels")
            q = _quality(ends(labels), total)
            best, most, worse = (labels, q, 0) if q > most + _SMALL else (best, most, worse + 1)
            # Both halves of one dealing, so that every node has had its turn.
            if worse >= 2 and turn % 2:
                break
        if most <= start + _SMALL:
            break
        step = best.select(F.col("node").alias("community"), F.col("community").alias("next"))
        home = written(home.join(step, "community").select("node", F.col("next").alias("community")), "home")
        both = written(ends(best).groupBy(F.col("c").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")
    names = home.groupBy("community").agg(F.min("node").alias("name"))
    return home.join(names, "community").select("node", F.col("name").alias("community"))
