"""Nearest vectors of many queries: blocks of queries broadcast to one pass, exact or by an inverted file.

Vectors are never shuffled for a search.  A block of queries, bounded by the numbers it holds, is broadcast; each task
multiplies it with its own vectors a batch at a time and hands on the k best a query, or the pairs that reach a
threshold.  An inverted file deals vectors to cells around centres found by k-means on a bounded sample; a query then
meets the vectors of its nearest cells only.  Every vector has a cell, and probing all cells is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written

#: Similarities are compared to this many places, then by id.
_PLACES = 9
#: Pairs of which a task holds the similarities at once.
_PAIRS = 2_000_000


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``dims`` finite numbers, and the vectors."""
    at = np.flatnonzero(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False), nan=-1) == dims)
    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    good = np.isfinite(x).all(1)
    return at[good], x[good]


class _Best:
    """The k best of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.reach = k, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit = 0, max(200_000, 4 * queries * k)

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((q, s, ids))
        self.size += len(q)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        q, s, ids = map(np.concatenate, zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        order = np.lexsort((ids, -np.round(s, _PLACES), q))
        q, s, ids = q[order], s[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.reach[q[last]] = np.round(s[last], _PLACES)
        self.parts, kept = [(q[place < self.k], s[place < self.k], ids[place < self.k])], int((place < self.k).sum())
        self.size = kept
        return self.parts[0]


def _scan(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, cells: np.ndarray | None, k: int | None, threshold: float | None) -> DataFrame:
    """(query_id, id, similarity) of one block; ``cells`` holds the cells that each query probes."""
    held = vectors.sparkSession.sparkContext.broadcast((ids, q, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, cells = held.value
        asked = None
        if cells is not None:
            asked = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}
        best = _Best(len(ids), k) if k else None

        def out(rows: np.ndarray, found: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(found), pa.array(s)], names=["query_id", "id", "similarity"])

        for b in batches:
            at, x = _matrix(b.column(b.schema.get_field_index("v")), q.shape[1])
            own = b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False)[at]
            groups = [(np.arange(len(q)), np.arange(len(own)))]
            if asked is not None:
                cell = b.column(b.schema.get_field_index("cell")).to_numpy(zero_copy_only=False)[at]
                groups = [(asked[int(c)], np.flatnonzero(cell == c)) for c in np.unique(cell) if int(c) in asked]
            for rows, places in groups:
                step = max(1, _PAIRS // max(1, len(rows)))
                for some in range(0, len(places), step):
                    part = places[some : some + step]
                    s = q[rows] @ x[part].T
                    least = threshold if threshold is not None else best.reach[rows][:, None]
                    i, j = np.nonzero((s >= least if threshold is not None else np.round(s, _PLACES) >= least) & (ids[rows][:, None] != own[part]))
                    if best:
                        best.add(rows[i], s[i, j], own[part][j])
                    elif len(i):
                        yield out(rows[i], own[part][j], s[i, j])
        if best:
            rows, s, found = best.cut()
            yield out(rows, found, s)

    columns = [F.col("id").cast("long").alias("id"), "v"] + (["cell"] if cells is not None else [])
    return vectors.select(*columns).mapInArrow(run, "query_id long, id long, similarity double")


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries(query_id, q), about ``block`` numbers at a time, one length at a time."""
    own = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").where("q IS NOT NULL AND query_id IS NOT NULL")
    for r in own.groupBy(F.size("q").alias("dims")).agg(F.count("*").alias("n")).orderBy("dims").collect():
        same = own.where(F.size("q") == r["dims"])
        n = max(1, -(-r["n"] * max(1, r["dims"]) // block))
        for i in range(n):
            got = same.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow().combine_chunks()
            for b in got.to_batches():
                at, x = _matrix(b.column(1), r["dims"])
                if len(at):
                    yield b.column(0).to_numpy()[at], x


def _united(parts: list[DataFrame], vectors: DataFrame) -> DataFrame:
    """All blocks' rows; each is written where there are several, so that plans stay small."""
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", _PLACES).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1 << 20) -> DataFrame:
    """(query_id, id, rank, similarity): the k others of highest dot product with every query, ties by id.

    queries(query_id, q), vectors(id, v), ids being long; vectors of another length, null or with numbers that are not finite take no part.
    """
    blocks = list(_written_blocks(vectors, queries, block, None, k, None))
    return _ranked(_united(blocks, vectors), k)


def reaching(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = 1 << 20) -> DataFrame:
    """(query_id, id, similarity): all others whose dot product with a query reaches the threshold."""
    return _united(list(_written_blocks(vectors, queries, block, None, None, threshold)), vectors)


def _written_blocks(vectors: DataFrame, queries: DataFrame, block: int, probe, k: int | None, threshold: float | None) -> Iterator[DataFrame]:
    waiting = None
    for ids, q in _blocks(queries, block):
        if waiting is not None:
            yield written(waiting, "block")
        cells = None if probe is None else probe(q)
        rows = vectors if cells is None else vectors.where(F.col("cell").isin(np.unique(cells).tolist()))
        waiting = _scan(rows, ids, q, cells, k, threshold)
    if waiting is not None:
        yield waiting


@dataclass
class Index:
    """Vectors(id, v, cell, ..) sorted by cell inside each file, and the centres of the cells."""

    table: DataFrame
    centres: np.ndarray


def centres_of(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means by Lloyd's rounds from distinct members of the sample; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:cells]].copy()
    for _ in range(rounds):
        near = nearest_centres(sample, centres, 1)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of every vector, nearest first, ties by number."""
    d = (centres * centres).sum(1) - 2 * (x @ centres.T)
    return np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :n]


def build(vectors: DataFrame, cells: int = 64, sample: int = 20_000) -> Index:
    """Index over vectors(id, v, ..): centres from at most ``sample`` of them (by a hash of the id), a cell for every one."""
    taken = vectors.where("v IS NOT NULL").select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("v").toArrow().combine_chunks()
    own = [_matrix(b.column(0), len(b.column(0)[0])) for b in taken.to_batches() if b.num_rows]
    dims = own[0][1].shape[1] if own else 0
    points = np.concatenate([x for _, x in own if x.shape[1] == dims]) if own else np.zeros((1, 0))
    centres = centres_of(points, cells)
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _matrix(b.column(b.schema.get_field_index("v")), held.value.shape[1])
            cell = nearest_centres(x, held.value, 1)[:, 0] if len(at) else np.empty(0, np.int64)
            yield b.take(pa.array(at, pa.int64())).append_column("cell", pa.array(cell.astype(np.int32)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), "cell int"])
    # No exchange by cell: a cell may hold a third of all vectors.
    return Index(written(vectors.mapInArrow(assign, schema).sortWithinPartitions("cell"), "cells"), centres)


def search(index: Index, queries: DataFrame, k: int, probes: int, block: int = 1 << 20) -> DataFrame:
    """``nearest`` among the vectors of the ``probes`` nearest cells of every query; all cells: exact."""

    def probe(q: np.ndarray) -> np.ndarray:
        same = q.shape[1] == index.centres.shape[1]
        return nearest_centres(q, index.centres, probes) if same else np.empty((len(q), 0), np.int64)

    return _ranked(_united(list(_written_blocks(index.table, queries, block, probe, k, None)), index.table), k)


def plan_probes(index: Index, queries: DataFrame, k: int, recall: float = 0.9, sample: int = 256) -> int:
    """The fewest probes that give this recall on at most ``sample`` of the queries (by a hash), measured against the exact search."""
    own = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = nearest(own, index.table, k).join(index.table.select("id", "cell"), "id").select("query_id", "cell").toArrow()
    order = {}
    for ids, q in _blocks(own.where(F.size("q") == index.centres.shape[1]), 1 << 20):
        order |= {int(i): row for i, row in zip(ids, nearest_centres(q, index.centres, len(index.centres)))}
    place = [int(np.flatnonzero(order[i] == c)[0]) for i, c in zip(exact["query_id"].to_pylist(), exact["cell"].to_pylist())]
    if not place:
        return len(index.centres)
    return int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1
