"""Vector search: top-k of one query with filters before or after, within groups, pairwise statistics.  Many queries: ``vector_index``."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import dot


def knn(vectors: DataFrame, query: list[float], k: int, prefilter=None, postfilter=None) -> DataFrame:
    """The k nearest of vectors(id, v, ..) by dot product; a prefilter keeps k rows, a postfilter may leave fewer."""
    rows = vectors if prefilter is None else vectors.where(prefilter)
    q = F.array(*[F.lit(float(x)) for x in query])
    top = rows.withColumn("similarity", dot(F.col("v"), q)).orderBy(F.round("similarity", 9).desc(), "id").limit(k)
    return top if postfilter is None else top.where(postfilter)


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k nearest of every query within the same key values (a group, a tenant, a cell of an index)."""
    pairs = queries.join(vectors, keys).where("query_id <> id").withColumn("similarity", dot(F.col("q"), F.col("v")))
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_statistics(vectors: DataFrame, group: str) -> DataFrame:
    """Pairs, mean and population deviation of the dot products within each group, without forming pairs.

    The sum over pairs comes from the vector of sums and the sum of squares from the matrix of second
    moments.  Every partition adds up both in numpy; what is shuffled is sized by the dimension, the
    partitions and the groups they hold, not by the rows.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, own in b.groupby("g"):
                x = np.stack(own["v"].tolist()).astype(float)
                d = (x * x).sum(1)
                parts = [("n", [float(len(x))]), ("s", x.sum(0)), ("m", (x.T @ x).ravel()), ("d1", [d.sum()]), ("d2", [(d * d).sum()])]
                yield pd.concat([pd.DataFrame({"g": g, "kind": k, "at": np.arange(len(a)), "x": a}) for k, a in parts])

    kind = vectors.schema[group].dataType.simpleString()
    sums = vectors.select(F.col(group).alias("g"), "v").mapInPandas(moments, f"g {kind}, kind string, at long, x double").groupBy("g", "kind", "at").agg(F.sum("x").alias("x"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    square = F.col("x") * F.col("x")
    j = sums.groupBy(F.col("g").alias(group)).agg(of("n", F.col("x")).alias("n"), of("s", square).alias("s2"), of("m", square).alias("m2"), of("d1", F.col("x")).alias("d1"), of("d2", F.col("x")).alias("d2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (F.col("s2") - F.col("d1")) / 2 / pairs
    variance = (F.col("m2") - F.col("d2")) / 2 / pairs - mean * mean
    return j.where("n > 1").select(group, pairs.cast("long").alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("stddev"))


def variance_score(mean: Column, stddev: Column) -> Column:
    """0..100 of how alike texts are: the mean similarity from 0.3 on, and more where the similarities vary little."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - 0.3) / 0.5)) * 100
    return F.least(F.lit(100.0), base + F.when(stddev < 0.08, 20).when(stddev < 0.12, 10).otherwise(0))


def similar_within(vectors: DataFrame, group: str, threshold: float, block: int = 4000) -> DataFrame:
    """Pairs (a < b) of a group whose dot product reaches the threshold; ``group`` bounds the search.

    A group is dealt into blocks of about ``block`` vectors, and every two blocks meet in a task of their own by matrix products,
    so a task's memory does not depend on how many vectors a group has.  All pairs are compared, over the shorter length as in ``dot``.
    """
    gap = F.array_position(F.transform("v", lambda c: c.isNull()), True)
    x = vectors.where(F.col(group).isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull())
    x = x.select(F.col(group).alias("g"), "id", F.transform("v", lambda c: F.coalesce(c.cast("double"), F.lit(0.0))).alias("v"), F.size("v").alias("dim"), F.when(gap > 0, gap - 1).otherwise(F.size("v")).cast("int").alias("known"))
    blocks = x.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("dim").alias("most"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    x = x.join(blocks, "g").withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.col("most") - F.col("dim")))).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    x = x.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v", "dim", "known", "most")
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    schema = StructType().add("g", kinds[group]).add("a", kinds["id"]).add("b", kinds["id"]).add("similarity", "double")

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:])
        ids, v = rows["id"].combine_chunks(), np.asarray(pc.list_flatten(rows["v"])).reshape(rows.num_rows, rows["most"][0].as_py())
        at, dim, known = (np.asarray(rows[c]) for c in ("own", "dim", "known"))
        found = []
        for d, e in itertools.product(np.unique(dim), repeat=2):
            # Vectors of two lengths meet over the shorter one; a number missing there leaves the pair out.
            width = min(d, e)
            left, right = np.flatnonzero((at == i) & (dim == d) & (known >= width)), np.flatnonzero((at == j) & (dim == e) & (known >= width))
            for k in range(0, len(left), 1000):
                some = left[k : k + 1000]
                s = v[some, :width] @ v[right, :width].T
                # Not below, as a product that is no number counts as reaching it in Spark.
                m, n = np.nonzero(~(s < threshold) & ((some[:, None] < right[None, :]) if i == j else True))
                found.append((some[m], right[n], s[m, n]))
        m, n, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        one, two = ids.take(pa.array(m)), ids.take(pa.array(n))
        first = pc.less(one, two)
        out = pa.table([pa.repeat(key[0], len(m)), pc.if_else(first, one, two), pc.if_else(first, two, one), pa.array(s)], ["g", "a", "b", "similarity"])
        return out.filter(pc.not_equal(out["a"], out["b"]))

    pairs = x.groupBy("g", "i", "j").applyInArrow(meet, schema)
    return pairs.select(F.col("g").alias(group), "a", "b", "similarity")
