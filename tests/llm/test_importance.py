"""Importance resampling against a plain computation."""

import collections
import hashlib
import math
import re
import zlib

import pytest

pytest.importorskip("talentspark.llm")
from talentspark.llm import importance  # noqa: E402

LONG = "the same words again and again " * 4000
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [None, "", "...", BASE, BASE.upper(), f"{BASE} ÄÖÜ äöü 日本語 x1y2", LONG, LONG, "one two", BASE.replace(" ", "\n"), BASE + "é\x00é"]


def brute(rows, target, percent=10, least=20, runs=1, buckets=10_000, seed=2024):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    own = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for *_, f in own for b in f), collections.Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = {id(x): k for k, x in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((i, n, w, sc, drawn.get(id(x))) for x in out for i, _, n, w, sc in [x]), key=str)


@pytest.mark.parametrize("percent, runs", [(10, 1), (50, 3), (100, 2)])
def test_against_plain(spark, percent, runs):
    rows = [*enumerate(TEXTS), (3, BASE), (None, BASE), *((i, f"{BASE} word{i % 13} alpha") for i in range(20, 80))]
    docs = spark.createDataFrame([(i, t, 1.0, 5) for i, t in rows], "doc_id long, text string, weight double, rank int")
    target = ["alpha beta beta tau", None, BASE, BASE]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, bench, percent=percent, runs=runs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, target, percent=percent, runs=runs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, BASE), (2, "x")], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert sorted(map(tuple, importance.resample(some, none, percent=100).collect()), key=str) == brute([(1, BASE), (2, "x")], [], percent=100)
