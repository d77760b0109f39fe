"""Skill graphs: co-occurrence, degrees, modularity, bridges, communities, term relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written


def cooccurrence(items: DataFrame) -> DataFrame:
    """Undirected edges (src < dst, weight) between items(group, item) of the same group."""
    x = items.select("group", "item").distinct()
    pairs = x.join(x.select("group", F.col("item").alias("dst")), "group").where(F.col("item") < F.col("dst"))
    return pairs.groupBy(F.col("item").alias("src"), "dst").agg(F.count("*").alias("weight"))


def cooccurrence_of_specs(terms: DataFrame) -> DataFrame:
    """Edges between terms(spec, term, importance) of the same spec: weight 2 where both are required (importance 0), else 1."""
    x = terms.groupBy("spec", "term").agg(F.min("importance").alias("i"))
    pairs = x.join(x.select("spec", F.col("term").alias("dst"), F.col("i").alias("j")), "spec").where(F.col("term") < F.col("dst"))
    return pairs.groupBy(F.col("term").alias("src"), "dst").agg(F.sum(F.when((F.col("i") == 0) & (F.col("j") == 0), 2).otherwise(1)).alias("weight"))


def projection(edges: DataFrame, dims: int = 2, most_nodes: int = 2000) -> DataFrame:
    """(node, x, y): coordinates by principal components of the rows of weights, at most ``most_nodes`` nodes; more raise.

    Signs are set so that the largest coordinate of each axis is positive.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if both.select("src").distinct().limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes; part the graph before projecting it")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="src", columns="dst", values="weight", aggfunc="sum", fill_value=0).sort_index()
        x = m.to_numpy(dtype=float)
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        at = u[:, :dims] * s[:dims]
        at = at * np.where(at[np.abs(at).argmax(0), np.arange(at.shape[1])] < 0, -1, 1)
        return pd.DataFrame({"node": m.index, "x": at[:, 0], "y": at[:, 1] if at.shape[1] > 1 else 0.0})

    return both.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(solve, "node string, x double, y double")


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of links(u, v), each component named by its smallest node; nodes without links are not there.

    A round takes the smallest label around and then that label's own label, so long chains settle in few rounds.  Each
    round is joins and aggregations, and is written, so a lost executor repeats that round only.
    """
    some = links.where(F.col("u") != F.col("v")).select("u", "v")
    both = written(some.unionByName(some.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label"))
    labels = written(labels.withColumn("changed", F.lit(True)), "labels")
    for _ in range(rounds):
        known = labels.select("node", "label")
        near = both.join(known, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        step = known.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        own = known.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(own, "label").select("node", "before", F.least("label", "further").alias("label"))
        labels = written(step.select("node", "label", (F.col("label") != F.col("before")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return both.groupBy("node").agg(F.sum("weight").alias("degree"), F.count("*").alias("neighbours"))


def top_by_community(edges: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k nodes of largest degree of each community(node, community)."""
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    return degrees(edges).join(members, "node").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: internal weight, total degree and its share of the modularity."""
    a = edges.join(members.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").join(members.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    inside = a.where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.sum("weight").alias("inside"))
    total = degrees(edges).join(members, "node").groupBy("community").agg(F.sum("degree").alias("total"))
    m = edges.agg(F.sum("weight").alias("m"))
    q = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("total") / (2 * F.col("m")), 2)
    # One row of totals, whatever the graph's size.
    return total.join(inside, "community", "left").join(F.broadcast(m)).select("community", F.coalesce("inside", F.lit(0)).alias("inside"), "total", q.alias("modularity"))


def bridges(edges: DataFrame, members: DataFrame, strong: DataFrame) -> DataFrame:
    """Strong nodes with edges into another community, with the weight that leads there."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    a = both.join(strong.select(F.col("node").alias("src")), "src").join(members.select(F.col("node").alias("src"), F.col("community").alias("home")), "src")
    a = a.join(members.select(F.col("node").alias("dst"), F.col("community").alias("target")), "dst").where("home <> target")
    return a.groupBy(F.col("src").alias("node"), "target").agg(F.sum("weight").alias("weight"))


def search_queries(edges: DataFrame, members: DataFrame, strengths: DataFrame, k: int = 3) -> DataFrame:
    """A search per community: its k nodes of largest degree, the mean strength(node, strength) of its nodes and what kind of search that makes."""
    top = top_by_community(edges, members, k).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("t"))
    top = top.select("community", F.array_join(F.transform("t", lambda x: x["node"]), " ").alias("terms"))
    mean = members.join(strengths, "node", "left").groupBy("community").agg(F.avg(F.coalesce("strength", F.lit(0.0))).alias("strength"))
    m = F.round("strength", 6)
    return top.join(mean, "community").withColumn("kind", F.when(m > 0.5, "strong").when(m > 0.2, "growth").otherwise("stretch"))


def widen(edges: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """Steps that widen a community's search: the least connected of its k terms to drop, the outside node most tied to the others to add."""
    top = top_by_community(edges, members, k).select("community", "node", "rank")
    w = Window.partitionBy("community")
    top = top.withColumn("last", (F.col("rank") == F.max("rank").over(w)) & (F.col("rank") > 1))
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = top.where("not last").join(both, F.col("node") == F.col("src")).join(members.select(F.col("node").alias("dst"), F.col("community").alias("there")), "dst")
    near = near.where("there <> community").groupBy("community", "dst").agg(F.sum("weight").alias("weight"))
    near = near.groupBy("community").agg(F.min_by(F.struct("dst", "weight"), F.struct(-F.col("weight"), F.col("dst"))).alias("b"))
    drop = top.groupBy("community").agg(F.max(F.when(F.col("last"), F.col("node"))).alias("dropped"))
    return drop.join(near, "community", "left").select("community", "dropped", F.col("b.dst").alias("added"), F.col("b.weight").alias("weight"))


def neighbour_queries(edges: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """(community, terms): the two strongest terms of a community's search with the strongest outside neighbours of two of its terms."""
    top = top_by_community(edges, members, k).select("community", "node", "rank")
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    inside = top.select("community", F.col("node").alias("dst"), F.lit(True).alias("asked"))
    near = top.join(both, F.col("node") == F.col("src")).join(inside, ["community", "dst"], "left").where("asked is null")
    best = near.groupBy("community", "rank").agg(F.min_by("dst", F.struct(-F.col("weight"), F.col("dst"))).alias("term"))
    listed = lambda df, c: df.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("term")))).alias("t")).select("community", F.slice(F.transform("t", lambda x: x["term"]), 1, 2).alias(c))
    return listed(top, "node").join(listed(best, "term"), "community").select("community", F.array_join(F.concat("node", "term"), " ").alias("terms"))


def adjacent_community(edges: DataFrame, members: DataFrame, strong: DataFrame) -> DataFrame:
    """One row: the community with most strong(node) skills, and the other community with most nodes tied to it."""
    own = members.join(strong.select("node").distinct(), "node").groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(1)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    home = members.join(own.select("community"), "community").select(F.col("node").alias("src"), F.col("community").alias("home"))
    near = both.join(home, "src").select(F.col("dst").alias("node"), "home").distinct().join(members, "node").where("community <> home")
    near = near.groupBy("home", "community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(1)
    return near.select(F.col("home").alias("community"), F.col("community").alias("adjacent"), "n")


def relations(lists: DataFrame, window: int = 5, longest: int | None = None) -> DataFrame:
    """Term pairs i < j < i + window within lists(group, position, term), of their first ``longest`` terms if given; the shorter term is canonical.

    Each term looks ``window`` terms ahead, so a list of any length costs its length times the window.
    """
    x = lists if longest is None else lists.where(F.col("position") < longest)
    ahead = x.select("group", F.explode(F.sequence(F.col("position") + 1, F.col("position") + window - 1)).alias("p2"), "term")
    pairs = ahead.join(x.select("group", F.col("position").alias("p2"), F.col("term").alias("t2")), ["group", "p2"]).where(F.col("term") != F.col("t2"))
    shorter = F.when(F.length("t2") < F.length("term"), F.col("t2")).otherwise(F.col("term"))
    return pairs.select(shorter.alias("canonical"), F.when(shorter == F.col("term"), F.col("t2")).otherwise(F.col("term")).alias("alias")).groupBy("canonical", "alias").agg(F.count("*").alias("n"))


def characterise(edges: DataFrame, members: DataFrame, seen: DataFrame, categories: DataFrame, k: int = 3) -> DataFrame:
    """Per community: members, dominant category, and a label of the k skills that lean most on it.

    A skill scores its share of weight inside the community times 0.5 + 0.5 min(documents / 3, 1), with
    seen(node, documents) and categories(node, category).
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    home, there = members.select(F.col("node").alias("src"), "community"), members.select(F.col("node").alias("dst"), F.col("community").alias("there"))
    inside = both.join(home, "src").join(there, "dst").groupBy("src").agg(F.sum(F.when(F.col("there") == F.col("community"), F.col("weight")).otherwise(0)).alias("own"), F.sum("weight").alias("total"))
    s = members.join(inside.withColumnRenamed("src", "node"), "node", "left").join(seen, "node", "left").join(categories, "node", "left")
    boost = 0.5 + 0.5 * F.least(F.coalesce("documents", F.lit(0)) / 3, F.lit(1.0))
    s = s.withColumn("score", F.round(F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)) * boost, 6))
    w = Window.partitionBy("community").orderBy(F.desc("score"), "node")
    top = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("t"))
    common = s.where("category is not null").groupBy("community", "category").agg(F.count("*").alias("n")).groupBy("community").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"))
    names = F.array_join(F.transform("t", lambda x: x["node"]), ", ")
    label = F.when(F.col("category").isNull(), names).otherwise(F.concat("category", F.lit(" ("), names, F.lit(")")))
    sizes = s.groupBy("community").agg(F.count("*").alias("members"))
    return sizes.join(top, "community").join(common, "community", "left").select("community", "members", "category", label.alias("label"))


def communities(edges: DataFrame, rounds: int = 200, most_edges: int = 5_000_000) -> DataFrame:
    """Greedy modularity moves in node order within each graph(graph, src, dst, weight); exact and deterministic a graph.

    A graph is one group: its nodes are a skill vocabulary, bounded by the taxonomy and not by the data.
    A graph of more than ``most_edges`` edges, or one that does not settle, raises.
    """
    if edges.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).take(1):
        raise ValueError(f"a graph has more than {most_edges} edges; part it before looking for communities")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, dict[str, float]] = {}
        for s, d, w in zip(pdf["src"], pdf["dst"], pdf["weight"]):
            near.setdefault(s, {})[d] = near.setdefault(s, {}).get(d, 0) + w
            near.setdefault(d, {})[s] = near.setdefault(d, {}).get(s, 0) + w
        degree = {n: sum(x.values()) for n, x in near.items()}
        m = sum(degree.values()) / 2
        home = {n: n for n in near}
        total = dict(degree)
        for _ in range(rounds):
            moved = False
            for n in sorted(near):
                own = home[n]
                total[own] -= degree[n]
                into: dict[str, float] = {own: 0.0}
                for x, w in near[n].items():
                    if x != n:
                        into[home[x]] = into.get(home[x], 0.0) + w
                best = max(sorted(into), key=lambda c: into[c] / m - total[c] * degree[n] / (2 * m * m) + (1e-12 if c == own else 0))
                total[best] = total.get(best, 0.0) + degree[n]
                home[n], moved = best, moved or best != own
            if not moved:
                break
        else:
            raise RuntimeError(f"communities of graph {pdf['graph'].iloc[0]!r} did not settle")
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "node": sorted(home), "community": [home[n] for n in sorted(home)]})

    return edges.groupBy("graph").applyInPandas(solve, "graph string, node string, community string")
