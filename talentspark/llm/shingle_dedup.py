"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's stage.

A text is the set of XXH64 of its five-word shingles (A-Z lower-cased, ASCII white space
parts words; a shorter text is one shingle).  Texts of equal sets are one class.  Two sets of
similarity t share one of their first n - ceil(t n) + 1 shingles in any common order, so
meeting on these prefixes loses no pair.  The order is by number of texts, rarest first, then by hash: a fixed
table of counters, summed over all texts, says how often the shingles of a counter occur, so what many unlike texts
share comes last at any size of the input.  The table only decides how large buckets become.

Pairs first come from SimHash: the 64 majority bits of each set, linked within two bits by the generalised pigeonhole
of ``simhash`` and verified on the sets.  Its components are where the exact meeting above starts from, so what
fingerprints bring together does not meet again, and what they miss is not lost.

Only connectivity is needed, so members of a bucket first meet its pivot; whatever is then still in different
components of a bucket meets pair by pair.  Pairs are ruled out inside these joins by sizes, positions and parities: each
shingle turns one of 1024 bits, so two texts' bits differ in at most as many places as their sets do.  What is left
falls by the counts of 256 groups of hashes (common shingles are at most the sum of the lesser counts), and every other
pair is verified on the whole sets, for which only its texts travel.  Components are those of all pairs at the
threshold or above.

Defined cases: null text counts as empty, and texts without a word are one class.  The row
kept of a component has the smallest id, rows without an id coming last, then the smallest
hash of its text, then the earliest row; so repeated and null ids are rows like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .runtime import materialize


_GROUPS, _PARITIES = 256, 1024


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=np.uint64))


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(n * threshold - 1e-9) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def counters(texts: DataFrame, k: int, bits: int = 22, slices: int = 256) -> np.ndarray:
    """How many texts have the shingles of each of ``2**bits`` counters; a table of fixed size whatever the input.

    Tasks add up their own texts, then tables are added up a slice at a time.
    """
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                at = (shingles(t, k) & np.uint64((1 << bits) - 1)).astype(np.int64)
                np.add.at(total, at, 1)
        yield sums(enumerate(total.reshape(slices, width)))

    def sums(parts) -> pa.RecordBatch:
        own = [(i, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for i, x in parts]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["slice", "counts"])

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, decompressed_size=8 * width, codec="zstd", asbytes=True), np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total.get(i, 0) + unpacked(x)
        yield sums(total.items())

    schema = "slice int, counts binary"
    added = texts.select("text").mapInArrow(count, schema).repartition(min(slices, 32), "slice").mapInArrow(add, schema)
    out = np.zeros((slices, width), np.int64)
    for r in added.collect():
        out[r["slice"]] = unpacked(r["counts"])
    return out.reshape(-1)


def majority(h: np.ndarray, block: int = 20_000) -> int:
    """The SimHash of a set of hashes: the bits that over half of them have, as a signed number."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(h), block):
        ones += np.unpackbits(h[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprint_pairs(classes: DataFrame, distance: int = 2, sample: int = 4096) -> DataFrame:
    """(u, v) of classes(node, fp): one pair for each further class of a fingerprint, and the links of fingerprints within ``distance`` bits.

    The masks are planned on at most ``sample`` fingerprints (by a hash); every class is probed.
    """
    own = materialize(classes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    taken = own.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(dtype=np.int64)
    same = classes.select("node", "fp").join(own.select("fp", F.col("node").alias("u")), "fp").where("u <> node").select("u", F.col("node").alias("v"))
    if not len(taken):
        return same
    return same.unionByName(simhash.links(own, simhash.plan_masks(taken, own.count(), distance), distance).select("u", "v"))


def signed(documents: DataFrame, often: np.ndarray, threshold: float, k: int) -> DataFrame:
    """(doc, row, sig): every document as a struct, a number for its row, and size, digest, fingerprint, prefix, counts and parities of its set."""
    table = documents.sparkSession.sparkContext.broadcast(often)

    @F.pandas_udf("n int, d1 long, d2 long, fp long, prefix array<long>, sketch binary, parity array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        out, mask = [], np.uint64(len(table.value) - 1)
        for t in texts:
            h = shingles(t, k)
            d = xxhash.xxh3_128_intdigest(h.tobytes())
            # h is sorted, so a stable sort by number orders by number, then hash.
            first = h[np.argsort(table.value[(h & mask).astype(np.int64)], kind="stable")[: prefix_length(len(h), threshold)]]
            sketch = np.minimum(np.bincount((h & np.uint64(_GROUPS - 1)).astype(np.int64), minlength=_GROUPS), 255).astype(np.uint8)
            turned = np.bincount((h >> np.uint64(40)).astype(np.int64) % _PARITIES, minlength=_PARITIES) & 1
            parity = np.packbits(turned.astype(np.uint8)).view(np.int64)
            out.append((len(h), *np.array([d >> 64, d & (2**64 - 1)], np.uint64).view(np.int64).tolist(), majority(h), first.view(np.int64), sketch.tobytes(), parity))
        return pd.DataFrame(out, columns=["n", "d1", "d2", "fp", "prefix", "sketch", "parity"])

    doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    return documents.select(doc.alias("doc"), F.monotonically_increasing_id().alias("row"), sign("text").alias("sig"))


def differ_little(n: Column, parity: Column, n2: Column, parity2: Column, threshold: float) -> Column:
    """Sets of these sizes and parities can reach the threshold: they may differ in this share of their members."""
    bits = sum((F.bit_count(F.get(parity, i).bitwiseXOR(F.get(parity2, i))) for i in range(_PARITIES // 64)), F.lit(0))
    return bits <= (1 - threshold) / (1 + threshold) * (n + n2) + 1e-9


def not_ruled_out(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that their sketches allow to reach the threshold; classes(node, n, sketch).

    A count of 255 stands for that many or more and rules nothing out.
    """
    side = lambda at, n, sketch: classes.select(F.col("node").alias(at), F.col("n").alias(n), F.col("sketch").alias(sketch))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x[c].tolist()), np.uint8).reshape(len(x), _GROUPS) for c in ("a", "b"))
            most = np.minimum(a, b).sum(1, dtype=np.int64)
            full = ((a == 255) & (b == 255)).any(1)
            yield x.loc[full | (most >= threshold / (1 + threshold) * (x["n"] + x["m"]).to_numpy() - 1e-9), ["u", "v"]]

    return pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v").mapInPandas(run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int, share: int = 64) -> DataFrame:
    """The pairs (u, v) at the threshold or above; texts(node, text).  A ``u`` of many pairs is dealt in shares."""
    load = pairs.groupBy("u").agg(F.ceil(F.count("*") / share).alias("s"))
    dealt = materialize(pairs.join(load, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("s"))).drop("s"), "dealt")
    # Only texts of pairs travel; the tables of numbers are written first so that small ones are broadcast.
    nodes = materialize(dealt.select(F.col("u").alias("node")).unionByName(dealt.select(F.col("v").alias("node"))).distinct(), "nodes")
    own = texts.join(nodes, "node", "left_semi")
    left = dealt.select("u", "salt").distinct().join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    right = dealt.join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for x in batches:
            good = []
            for u, a, b in zip(x["u"], x["a"], x["b"]):
                if u != at:
                    at, own = u, shingles(a, k)
                good.append(similar(own, shingles(b, k), threshold))
            yield x.loc[np.array(good, bool), ["u", "v"]]

    return left.join(right, ["u", "salt"]).select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def possible(n: Column, at: Column, n2: Column, at2: Column, threshold: float) -> Column:
    """Sets of these sizes whose first common shingle has these positions can reach the threshold."""
    return (F.least(n, n2) >= threshold * F.greatest(n, n2) - 1e-9) & (F.least(n - at, n2 - at2) >= threshold / (1 + threshold) * (n + n2) - 1e-9)


def components(classes: DataFrame, texts: DataFrame, threshold: float = 0.8, k: int = 5, rounds: int = 2) -> DataFrame:
    """(node, component) of the linked classes(node, n, fp, prefix, sketch, parity); others are not in the result."""
    tokens = classes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token"), "shared")
    inside = materialize(tokens.join(shared, "token"), "inside")
    # Only what shares a token carries its parities.
    parities = materialize(classes.select("node", "parity").join(inside.select("node").distinct(), "node"), "parities")
    near = fingerprint_pairs(classes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = materialize(verified(materialize(not_ruled_out(near, classes, threshold), "met"), texts, threshold, k), "linked")
    labels = connected_components(edges)
    for turn in range(rounds + 1):
        now = materialize(inside.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
        # First the member with the fewest rarer shingles, which is what near copies are copies of if that is there.
        centre = F.col("at") if turn == 0 else F.lit(0)
        pivot = F.min(F.struct(centre.alias("c"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "at", "component")).alias("p")
        open_ = now.groupBy("token").agg(pivot, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        if turn < rounds:
            met = now.join(open_.select("token", "p"), "token").where(F.col("component") != F.col("p.component"))
            met = met.where(possible(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at"), threshold)).select(F.col("p.node").alias("u"), F.col("node").alias("v"))
        else:
            rest = materialize(now.join(open_.select("token"), "token").join(parities, "node"), "rest")
            other = rest.select("token", *[F.col(c).alias(c + "2") for c in ("node", "n", "at", "component", "parity")])
            good = possible(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), threshold) & differ_little(F.col("n"), F.col("parity"), F.col("n2"), F.col("parity2"), threshold)
            met = rest.join(other, (rest["token"] == other["token"]) & (F.col("component") < F.col("component2")) & good)
            met = met.select(F.col("node").alias("u"), F.col("node2").alias("v"))
        met = materialize(not_ruled_out(met.distinct(), classes, threshold), "met")
        found = materialize(verified(met, texts, threshold, k), "linked")
        edges = edges.unionByName(found)
        labels = connected_components(edges)
    return labels


def keep_first(documents: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """One row of every component of documents(doc_id, text, ..), all columns as they were."""
    rows = materialize(signed(documents, counters(documents, k), threshold, k), "signed")
    text = F.col("doc.text")
    order = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), F.xxhash64(text).alias("h"), "row")
    classes = materialize(rows.groupBy("sig.d1", "sig.d2").agg(F.min("row").alias("node"), F.min(order).alias("first")), "classes")
    one = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "sig.n", "sig.fp", "sig.prefix", "sig.sketch", "sig.parity")
    one = materialize(one, "sets")
    labels = components(one, rows.select(F.col("row").alias("node"), text.alias("text")), threshold, k)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = named.groupBy("component").agg(F.min("first").alias("kept")).select("component", F.col("kept.row").alias("kept"))
    # Rows that go are fewer than those that stay, and only their numbers have to reach the rows.
    gone = rows.select("row", "sig.d1", "sig.d2").join(named.join(kept, "component").select("d1", "d2", "kept"), ["d1", "d2"]).where("row <> kept")
    return rows.join(materialize(gone.select("row"), "gone"), "row", "left_anti").select("doc.*")
