"""Operator 13: exact search of the highest inner products by multi-resolution segment statistics.

Vectors become whole numbers floor(scale * x).  A vector is cut into segments, at several resolutions; of each segment
the mean and the standard deviation are kept.  By Cauchy and Schwarz the distance of two vectors is bounded from below by

    d(q, x)^2  >=  sum over segments of  length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and with <q, x> = (|q|^2 + |x|^2 - d^2) / 2 a lower bound of the distance is an upper bound of the score.  Each task
holds, for every query, the k-th best score it knows; candidates go through the resolutions from coarse to fine, and only
those whose bound reaches that score at every resolution are scored exactly.  Whatever is cut off cannot be in the
result, so the search is exact.

Queries come in blocks of a set number of numbers (``block``), each broadcast to one pass over all candidates, so neither
candidates nor pairs are shuffled.  The first scores a query knows come from a fixed number of candidates (``seeds``, by a
hash), found before the pass: they only tighten the bounds.  A task sends at most k rows a query, and none under the
query's first score; a query's rows of all tasks meet in one group of that bounded size a task.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors of different lengths
do not meet; empty vectors score 0; ties go to the smaller id, rows without an id come last; repeated ids are rows like
any other, and a query meets all rows but its own; a score beyond 64 bits stops at their end; numbers too large for exact
double sums are multiplied as integers of any size.  An empty table gives an empty result.  Only the two named columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

#: Sums of products under this are exact in doubles.
_EXACT = 2.0**52
_LONG = (1 << 63) - 1


def usable(vector: Column, scale: int) -> Column:
    """Neither null nor with a component that is null, not finite or, scaled, beyond a double."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * float(scale)) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles; from 2**53 on doubles are whole numbers anyway."""

    def one(x: Column) -> Column:
        v = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)

    return F.transform(vector, one)


def segments(dims: int, first: int = 2, fold: int = 4, least: int = 2) -> list[np.ndarray]:
    """Starts of the segments of each resolution, coarse to fine, down to about ``least`` components a segment."""
    out, n = [], first
    while n <= dims // least:
        out.append(np.unique(np.linspace(0, dims, n, endpoint=False).astype(int)))
        n *= fold
    return out


class _Resolution:
    """Segment means and deviations of vectors, scaled by the root of the segment's length: distances then just add up."""

    def __init__(self, starts: np.ndarray, dims: int):
        self.starts, self.length = starts, np.diff(starts, append=dims).astype(float)

    def statistics(self, x: np.ndarray) -> np.ndarray:
        total, squares = np.add.reduceat(x, self.starts, axis=1), np.add.reduceat(x * x, self.starts, axis=1)
        spread = np.sqrt(np.maximum(squares - total * total / self.length, 0.0))
        return np.hstack([total / np.sqrt(self.length), spread])


class Queries:
    """A block of queries of one length: row, whole numbers, statistics and the score to reach."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray):
        self.rows, self.x = rows, vectors
        dims = vectors.shape[1]
        self.levels = [_Resolution(s, dims) for s in segments(dims)]
        self.stats = [level.statistics(self.x) for level in self.levels]
        self.square = (self.x * self.x).sum(1)
        self.reach = np.full(len(rows), -np.inf)

    def survivors(self, x: np.ndarray, reach: np.ndarray, part: int = 512) -> Iterator[tuple[int, np.ndarray]]:
        """(query, places of candidates in ``x`` whose bounds reach its score at every resolution)."""
        stats, square = [level.statistics(x) for level in self.levels], (x * x).sum(1)
        for at in range(0, len(self.rows), part):
            own = slice(at, at + part)
            both = self.square[own, None] + square
            # Rounding is far below this share of the numbers a bound is made of.
            most = both * (0.5 + 1e-9) + 1e-6 - reach[own, None]
            alive = np.ones(both.shape, bool)
            for q, c in zip(self.stats, stats):
                i, j = np.nonzero(alive)
                if len(i) * 4 > alive.size:
                    least = (q[own] ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * (q[own] @ c.T)
                    alive &= ~(least > 2 * most)
                    continue
                for some in range(0, len(i), 50_000):
                    a, b = i[some : some + 50_000], j[some : some + 50_000]
                    alive[a, b] = ~(((q[own][a] - c[b]) ** 2).sum(1) > 2 * most[a, b])
            for i in np.flatnonzero(alive.any(1)):
                yield at + int(i), np.flatnonzero(alive[i])


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers held as doubles."""
    if exact:
        return (x @ q).astype(np.int64)
    own = [int(v) for v in q]
    return np.array([max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(own, row)))) for row in x], dtype=np.int64)


def _below(score: int) -> float:
    """A double not above ``score``."""
    return float(score) if abs(score) < _EXACT else float(np.nextafter(float(score), -np.inf))


def _matrix(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, their vectors) for each length of vectors."""
    lists = batch.column(batch.schema.get_field_index(name))
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        own = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, own.astype(np.float64).reshape(len(at), int(n))


def _best(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among ties."""
    return np.lexsort((ident, ~score))[:k]


def _searched(candidates: DataFrame, queries: dict[int, Queries], k: int) -> DataFrame:
    """(query, row, ident, score): of each task's candidates at most k a query, none below the query's first score."""
    held = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        reach = {dims: q.reach.copy() for dims, q in held.value.items()}
        for b in batches:
            rows, idents = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("row", "ident"))
            for places, x in _matrix(b, "numbers"):
                q, dims = held.value.get(x.shape[1]), x.shape[1]
                if q is None:
                    continue
                high = np.abs(q.x).max(1, initial=0) * np.abs(x).max(initial=0) * dims
                for some in range(0, len(places), 2048):
                    at, block = places[some : some + 2048], x[some : some + 2048]
                    for i, near in q.survivors(block, reach[dims]):
                        score = _products(q.x[i], block[near], high[i] < _EXACT)
                        good = (score >= reach[dims][i]) & (rows[at[near]] != q.rows[i])
                        if good.any():
                            new = score[good], idents[at[near[good]]], rows[at[near[good]]]
                            if old := kept.get((dims, i)):
                                new = tuple(map(np.concatenate, zip(old, new)))
                            first = _best(new[0], new[1], k)
                            kept[dims, i] = new = tuple(part[first] for part in new)
                            if len(first) == k:
                                reach[dims][i] = max(reach[dims][i], _below(int(new[0][-1])))
        for (dims, i), (score, ident, row) in kept.items():
            query = pa.array([int(held.value[dims].rows[i])] * len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([query, *(pa.array(v, pa.int64()) for v in (row, ident, score))], names=["query", "row", "ident", "score"])

    return candidates.mapInArrow(run, "query long, row long, ident long, score long")


def search(vectors: DataFrame, is_query: Column, ident: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64, block: int = 1 << 20, seeds: int = 4096) -> DataFrame:
    """(query_id, rank, ident, score): the k candidates of highest score of every query row, all other rows being candidates.

    ``block`` is the count of numbers (queries times components) that are broadcast at once, ``seeds`` that of the
    candidates that give queries their first scores.
    """
    at = F.col(f"`{vector}`")
    own = vectors.where(usable(at, scale)).select(F.col(f"`{ident}`").alias("id"), is_query.alias("is_query"), whole_numbers(at, scale).alias("numbers"))
    table = materialize(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    candidates = table.select("row", F.coalesce("id", F.lit(_LONG)).alias("ident"), "numbers")
    asked = table.where("is_query").select("row", "numbers")
    numbers = asked.agg(F.sum(F.greatest(F.size("numbers"), F.lit(1)))).first()[0] or 0
    blocks = -(-numbers // block)
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))), "queries")
    seeding = materialize(candidates.orderBy(F.xxhash64("row"), "row").limit(seeds), "seeds")
    parts = []
    for n in range(blocks):
        queries: dict[int, Queries] = {}
        for batch in asked.where(F.col("block") == n).toArrow().combine_chunks().to_batches():
            rows = batch.column(0).to_numpy()
            queries |= {x.shape[1]: Queries(rows[at], x) for at, x in _matrix(batch, "numbers")}
        place = {int(r): (q, i) for q in queries.values() for i, r in enumerate(q.rows)}
        first = _searched(seeding, queries, k).groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("best"))
        for r in first.where(F.size("best") >= k).select("query", F.get("best", F.lit(k - 1)).alias("score")).collect():
            q, i = place[r["query"]]
            q.reach[i] = _below(r["score"])
        parts.append(materialize(_searched(candidates, queries, k), "found"))
    found = parts[0] if parts else _searched(candidates.where("false"), {}, k)
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "ident", "row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = table.select("row", "id")
    named = top.join(ids.withColumnRenamed("id", ident), "row").drop("row")
    return named.join(ids.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", ident, "score")
