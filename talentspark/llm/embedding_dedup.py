"""Operator 8: near-duplicate vectors by random hyperplanes, exact cosines and components.

Equal vectors (by a digest of their numbers) are one node with a multiplicity.  Several
tables of sign hashes bring candidates together; the number of bits follows the number of
vectors (an eighth of a chance companion a bucket) and the number of tables follows the
wanted recall at the threshold.  Only node numbers and bucket keys are shuffled for that.
Pairs of buckets of at most ``small`` nodes are made distinct and fetch their vectors once
for an exact cosine in double precision.  A node that is in any larger bucket is hot; pairs
of two hot nodes are left to runs: rows of a bucket meet inside tasks by matrix products,
buckets over ``block`` nodes are split and their block pairs dealt out as separate runs,
so none is held whole by a task.  A pair that meets in several runs counts at the first
table; a run gives link counts and a spanning forest of its links, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length never link; equal vectors link with each
other; a cosine equal to the threshold links.  Repeated ids are rows of their own that share a
name; a row without an id counts in the links of others, is never ``kept`` and has the
smallest id it reaches, null if there is none (unusable vectors have their own id).  An
empty table gives an empty result.  Only the id and vector columns are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import materialize


def plan(vectors: int, threshold: float, recall: float = 0.985) -> tuple[int, int]:
    """(bits, tables): an eighth of a chance companion a bucket, pairs at the threshold are found at ``recall``."""
    bits = min(44, max(6, math.ceil(math.log2(max(2, vectors))) + 3))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    signs = (x @ _planes(x.shape[1], bits, tables, seed) > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


class _Forest:
    """Union-find over the rows of one run."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = self.up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _verify(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts (u, null, links) and forest edges (u, v, null) of complete runs sorted by run."""
    key = rows[["t", "b", "i", "j", "dim"]].to_numpy(dtype=np.int64)
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    end = np.append(start[1:], len(rows))
    rep, mult = rows["rep"].to_numpy(dtype=np.int64), rows["mult"].to_numpy(dtype=np.int64)
    own = rows["own"].to_numpy(dtype=np.int64)
    links, forest, edges = np.zeros(len(rows), np.int64), _Forest(), []
    vectors, sigs = rows["v"].tolist(), rows["sig"].tolist()  # bytes, arrays
    for a, z in zip(start.tolist(), end.tolist()):
        if z - a < 2:
            continue
        t, _, i, j, _ = key[a]
        x = np.frombuffer(b"".join(vectors[a:z]), dtype=np.float64).reshape(z - a, -1)
        s = np.stack(sigs[a:z])[:, : t + 1]
        left = np.arange(a, z) if i == j else np.flatnonzero(own[a:z] == i) + a
        right = left if i == j else np.flatnonzero(own[a:z] == j) + a
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            p, q = np.nonzero(x[part - a] @ x[right - a].T >= threshold)
            p, q = part[p], right[q]
            keep = p < q if i == j else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            first = ~(s[p - a, :t] == s[q - a, :t]).any(1)
            p, q = p[first], q[first]
            np.add.at(links, p, mult[q])
            np.add.at(links, q, mult[p])
            for u, v in zip(rep[p].tolist(), rep[q].tolist()):
                if forest.join(u, v):
                    edges.append((min(u, v), max(u, v)))
    some = np.flatnonzero(links)
    counts = pd.DataFrame({"u": rep[some], "v": pd.array([None] * len(some), "Int64"), "links": links[some]}).groupby("u", as_index=False).agg({"links": "sum"})
    counts["v"] = pd.array([None] * len(counts), "Int64")
    tree = pd.DataFrame({"u": [e[0] for e in edges], "v": pd.array([e[1] for e in edges], "Int64"), "links": pd.array([None] * len(edges), "Int64")})
    counts["links"] = counts["links"].astype("Int64")
    return pd.concat([counts[["u", "v", "links"]], tree], ignore_index=True)


def prepared(rows: DataFrame) -> DataFrame:
    """(row, vec_id, digest, dim, v) of rows(row, vec_id, x): unit vectors as bytes; unusable vectors have null digest and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, dim, unit = [], [], []
            for x in b.column(b.schema.get_field_index("x")):
                v = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x.values) and not x.values.null_count else np.zeros(0)
                if not len(v) or not np.isfinite(v).all() or not v.any():
                    digest.append(None), dim.append(None), unit.append(None)
                    continue
                v = v + 0.0  # no negative zeros
                digest.append(hashlib.sha256(v.tobytes()).digest())
                v = v / np.abs(v).max()
                dim.append(len(v)), unit.append((v / np.sqrt(v @ v)).tobytes())
            own = [b.column(b.schema.get_field_index(n)) for n in ("row", "vec_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(digest, pa.binary()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], names=["row", "vec_id", "digest", "dim", "v"])

    return rows.mapInArrow(run, f"row long, vec_id {rows.schema['vec_id'].dataType.simpleString()}, digest binary, dim int, v binary")


def _vectors(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def signed(unique: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(node, dim, bs) of unique(node, dim, v): the bucket of each node in each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in b.groupby("dim"):
                yield pd.DataFrame({"node": own["node"], "dim": dim, "bs": list(_signatures(_vectors(own["v"].tolist()), bits, tables, seed))})

    return unique.select("node", "dim", "v").mapInPandas(run, "node long, dim int, bs array<long>")


def verified(pairs: DataFrame, unique: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of nodes whose cosine reaches the threshold."""
    a = unique.select(F.col("node").alias("u"), F.col("v").alias("x"))
    b = unique.select(F.col("node").alias("v"), F.col("v").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            size = p["x"].map(len)
            for n in size.unique():
                own = p[size == n]
                near = (_vectors(own["x"].tolist()) * _vectors(own["y"].tolist())).sum(1) >= threshold
                yield own.loc[near, ["u", "v"]]

    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInPandas(run, "u long, v long")


def hot_links(inside: DataFrame, hot: DataFrame, unique: DataFrame, sigs: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, null, links) and forest edges (u, v, null) of all pairs of hot nodes that share a bucket."""
    own = inside.select("t", "b", "dim", "node").join(hot, "node")
    sizes = own.groupBy("t", "b", "dim").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    runs = own.join(sizes, ["t", "b", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    runs = runs.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    runs = runs.select("t", "b", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    full = unique.join(hot, "node").join(sigs.select("node", "bs"), "node").select("node", F.col("node").alias("rep"), "mult", "v", F.col("bs").alias("sig"))
    run_key = ["t", "b", "dim", "i", "j"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (rest[run_key] != rest[run_key].iloc[-1]).any(axis=1).to_numpy()
            done = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if done:
                yield _verify(rest.iloc[:done], threshold)
                rest = rest.iloc[done:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _verify(rest, threshold)

    dealt = runs.join(full, "node").select(*run_key, "own", "rep", "mult", "v", "sig")
    return dealt.repartition(*run_key).sortWithinPartitions(*run_key).mapInPandas(verify, "u long, v long, links long")


def near_duplicate_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    recall: float = 0.985, block: int = 1024, small: int = 16, seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = materialize(prepared(rows.withColumn("row", F.monotonically_increasing_id())), "vectors")
    usable = rows.where(F.col("digest").isNotNull())
    first = usable.groupBy("digest").agg(F.min("row").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    first = materialize(first, "first")
    unique = materialize(usable.select(F.col("row").alias("node"), "dim", "v").join(first.drop("digest"), "node"), "unique")
    bits, tables = plan(first.count(), threshold, recall)
    sigs = materialize(signed(unique, bits, tables, seed), "signed")
    probes = sigs.select("node", "dim", F.posexplode("bs").alias("t", "b"))
    sizes = probes.groupBy("t", "b", "dim").agg(F.count("*").alias("n")).where("n > 1")
    inside = materialize(probes.join(sizes, ["t", "b", "dim"]), "inside")
    hot = materialize(inside.where(F.col("n") > small).select("node").distinct(), "hot")
    # Pairs of small buckets, but for those of two hot nodes.
    low = inside.where(F.col("n") <= small).join(hot.withColumn("hot", F.lit(True)), "node", "left")
    other = low.select("t", "b", "dim", F.col("node").alias("v"), F.col("hot").alias("hot2"))
    met = low.select("t", "b", "dim", F.col("node").alias("u"), "hot").join(other, ["t", "b", "dim"])
    met = materialize(met.where((F.col("u") < F.col("v")) & (F.col("hot").isNull() | F.col("hot2").isNull())).select("u", "v").distinct(), "met")
    links = materialize(verified(met, unique, threshold), "links")
    edges = links
    mult = unique.select(F.col("node").alias("v"), F.col("mult").alias("links"))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counts = both.join(mult, "v").select(F.col("u").alias("node"), "links")
    if hot.take(1):
        found = materialize(hot_links(inside, hot, unique, sigs, threshold, block), "hot-links")
        counts = counts.unionByName(found.where(F.col("links").isNotNull()).select(F.col("u").alias("node"), "links"))
        edges = edges.unionByName(found.where(F.col("v").isNotNull()).select("u", "v"))
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(edges)
    named = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "names")
    named = named.join(names, "component").join(counts, "node", "left")
    named = named.select("digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    # Unusable vectors have no digest to meet on; they stay out of the join.
    out = usable.join(named, "digest").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(F.col("digest").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
