"""Components of op6 for null and repeated ids, against a plain closure over rows."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("talentspark.llm")
from talentspark.llm import simhash  # noqa: E402


def closure(rows, distance=2):
    """Row by row: the smallest id among all rows reachable by links of fingerprints."""
    out = []
    for i, f in rows:
        met, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, g in rows:
                if g not in met and bin((x ^ g) & (2**64 - 1)).count("1") <= distance:
                    met.add(g)
                    todo.append(g)
        ids = [j for j, g in rows if g in met and j is not None]
        out.append((i, f, min(ids) if ids else None))
    return sorted(out, key=str)


def components(spark, monkeypatch, rows):
    given = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda documents, shingle=3: given)
    return sorted(map(tuple, simhash.near_duplicates(given.withColumn("text", F.lit(""))).collect()), key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 0b0), (None, 0b11), (3, 0b1111)],
        [(5, 7), (3, 6), (5, 7 ^ (0xFFFFFFFFFFFF << 8)), (9, 6 ^ (0xFFFFFFFFFFFF << 8))],
        [(None, 1), (None, 1), (None, -1), (2, -2)],
        [(4, 0), (4, 0), (4, 2**40), (1, 2**62 - 1)],
    ],
)
def test_given_fingerprints(spark, monkeypatch, rows):
    assert components(spark, monkeypatch, rows) == closure(rows)


def test_random_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        f = rng.getrandbits(63)
        for _ in range(8):
            rows.append((rng.choice([None, rng.randrange(40)]), f))
            f ^= 1 << rng.randrange(63)
            f ^= 1 << rng.randrange(63)
    assert components(spark, monkeypatch, rows) == closure(rows)


def test_texts(spark):
    """Equal and near texts under null and repeated ids, through the operator's own fingerprints."""
    words = "one two three four five six seven eight nine ten " * 40
    texts = [(None, words), (7, words), (7, "other " * 30), (2, words), (None, "other " * 30), (None, "alone")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2), (7, 2), (2, 2), (7, 7), (None, 7), (None, None)], key=str)


def test_stage_fingerprints(spark):
    """The pipeline stage's fingerprints by counting bits, and its pairs against all pairs within two bits; equal fingerprints are linked."""
    import numpy as np

    from talentspark.llm import shingle_dedup
    from talentspark.llm.components import connected_components

    h = shingle_dedup.shingles("a b c d e f g h i j k")
    naive = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
    assert shingle_dedup.majority(h) % 2**64 == naive and shingle_dedup.majority(h, 3) % 2**64 == naive and shingle_dedup.majority(h[:0]) == 0
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(-(2**62), 2**62, 60)]
    fps += [x ^ (1 << int(rng.integers(60))) for x in fps[:40]] + fps[20:50]
    pairs = shingle_dedup.fingerprint_pairs(spark.createDataFrame(list(enumerate(fps)), "node long, fp long"))
    got = {r["node"]: r["component"] for r in connected_components(pairs).collect()}
    want = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            want[i] = min(want[j] for j, b in enumerate(fps) if ((a ^ b) % 2**64).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(fps))] == want
