"""Operator 6: SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints (majority bits of the XXH64 of their word shingles).
Two fingerprints within ``distance`` bits agree, for partitions of the bits with
thresholds t_1..t_m that sum to distance - m + 1, on some partition up to t_i bits.
Correlated bits share a partition; a dynamic program over estimated candidate counts
allocates the unequal thresholds (-1: the partition is not probed).  A partition with
threshold t is probed by masks that leave out t of its bits: fingerprints that agree
under a mask form a bucket.

Small buckets are compared pair by pair.  A fingerprint in any large bucket is keyed, once,
by itself and its variants of half the distance in bits (65 at two bits): fingerprints that
share such a key are within the distance of each other, and all pairs within it share one,
so buckets of any size cost as many rows a fingerprint as it has variants.  Both ways are
exact, so the bound between them only decides the cost.  Exact copies are one fingerprint
throughout.  Links become components by ``components``.

Defined cases: null text counts as empty; texts without a word have fingerprint zero and
link like any other; a bit set in exactly half the shingles is 0; very long texts are
hashed whole, a block of shingles at a time; repeated and null ids stay separate rows that
link by their own fingerprints, a component being named by its smallest id (null where none has one); an empty table gives
an empty result.  Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import add_columns, materialize

BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); A-Z lower-cased, ASCII white space parts words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n < 1:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(n)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 20_000):
        part = grams[at : at + 20_000]
        hashes = np.array([h(g, 42) for g in part], dtype=np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(grams)).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit number."""

    def start():
        return lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], dtype=np.int64)}

    return add_columns(documents.select("doc_id", "text"), "fp long", start)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def partitions(sample: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bit positions (0: highest), each grown from bits that correlate most with it."""
    bits = _bits(sample).astype(float)
    spread = bits.std(0)
    c = np.zeros((BITS, BITS))
    if len(sample) > 2:
        z = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
        c = np.abs(z.T @ z) / len(sample)
    np.fill_diagonal(c, 0)
    free = list(range(BITS))
    out = []
    for k in range(m):
        size = len(free) // (m - k)
        own = [max(free, key=lambda b: (c[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (c[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (one a partition) that sum to ``total`` at the least summed cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in cost.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan_masks(sample: np.ndarray, rows: int, distance: int = 2) -> list[int]:
    """Masks (signed 64-bit; set bits must agree) of the cheapest allocation over several partition counts."""
    scale = (rows / max(1, len(sample))) ** 2
    choice: tuple[float, list[int]] = (float("inf"), [])
    for m in range(1, distance + 4):
        groups = partitions(sample, m)
        costs = []
        for own in groups:
            cost = {-1: 0.0}
            for t in range(distance + 1):
                masks = [_mask([b for b in own if b not in out]) for out in combinations(own, t)]
                if len(masks) > 300:
                    break
                pairs = 0.0
                for mask in masks[:: max(1, len(masks) // 8)]:
                    n = np.unique(sample & np.int64(mask), return_counts=True)[1]
                    # Chance agreement beside what the sample shows, so that a small sample does not read as none.
                    pairs += (n * (n - 1)).sum() / 2 * scale + rows**2 / 2 / 2.0 ** bin(mask & (2**64 - 1)).count("1")
                cost[t] = pairs / len(masks[:: max(1, len(masks) // 8)]) * len(masks) + 3.0 * rows * len(masks)
            costs.append(cost)
        got = allocate(costs, distance - m + 1)
        if got[0] < choice[0]:
            masks = [_mask([b for b in own if b not in out]) for own, t in zip(groups, got[1]) if t >= 0 for out in combinations(own, t)]
            choice = (got[0], masks)
    return choice[1]


def _mask(positions: list[int]) -> int:
    value = sum(1 << (BITS - 1 - b) for b in positions)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(nodes: DataFrame, masks: list[int], distance: int = 2, small: int = 32) -> DataFrame:
    """Edges (u, v) among nodes (fp, node): all pairs within ``distance`` bits are connected through them."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)])
    probes = nodes.withColumn("p", F.explode(table)).select("fp", "node", F.col("p.i").alias("i"), F.col("fp").bitwiseAND(F.col("p.m")).alias("k"))
    sizes = probes.groupBy("i", "k").agg(F.count("*").alias("n")).where("n > 1")
    inside = materialize(probes.join(sizes, ["i", "k"]), "buckets")
    low = inside.where(F.col("n") <= small)
    right = low.select("i", "k", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance
    pairs = low.join(right, ["i", "k"]).where((F.col("node") < F.col("node2")) & near).select(F.col("node").alias("u"), F.col("node2").alias("v"))
    # Large buckets: each fingerprint once, under its variants of up to half the distance in flipped bits, whatever number of large
    # buckets it is in.  What shares a key is within the distance, and all pairs within it share one.
    large = inside.where(F.col("n") > small).select("fp", "node").distinct()
    few = _variants(large, distance // 2)
    if distance % 2 == 0:
        # At most 65 fingerprints share a key at two bits.
        keyed = few.groupBy("key").agg(F.min("node").alias("u"), F.collect_list("node").alias("vs")).where(F.size("vs") > 1)
        met = keyed.select("u", F.explode("vs").alias("v"))
    else:
        # An odd distance: the smallest near fingerprint of a key links to the farther ones.
        stars = few.groupBy("key").agg(F.min("node").alias("u"))
        met = _variants(large, distance // 2 + 1).join(stars, "key").select("u", F.col("node").alias("v"))
    return pairs.unionByName(met.where("u <> v"))


def _variants(nodes: DataFrame, flips: int) -> DataFrame:
    """(node, key): every fingerprint with up to ``flips`` of its bits turned."""
    if flips > 2:
        raise ValueError("large buckets are solved up to four bits")
    masks = [_mask(list(out)) for n in range(flips + 1) for out in combinations(range(BITS), n)]
    table = F.array(*[F.lit(m).cast("long") for m in masks])
    return nodes.select("node", F.explode(F.transform(table, lambda b: F.col("fp").bitwiseXOR(b))).alias("key"))


def near_duplicates(documents: DataFrame, distance: int = 2, shingle: int = 3, sample: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id): components of all documents linked within ``distance`` bits.

    The plan of masks is fitted on at most ``sample`` fingerprints (by a hash); every document is probed.
    """
    docs = materialize(fingerprints(documents, shingle), "fingerprints")
    # A fingerprint is its own number: ids may be null or repeated and only name components in the end.
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("node", F.col("fp")), "nodes")
    taken = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(dtype=np.int64)
    if not len(taken):
        return docs.withColumn("component_id", F.col("doc_id"))
    edges = links(nodes, plan_masks(taken, nodes.count(), distance), distance)
    labels = connected_components(edges)
    placed = nodes.join(labels, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(names, "component").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")
