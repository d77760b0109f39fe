"""Exact medians against the sorted values."""

import random
import statistics

import pytest

from talentspark.operators import quantiles


@pytest.mark.parametrize("slack", [0.005, 0.4])
def test_exact_median(spark, slack):
    rng = random.Random(3)
    groups = {"odd": [rng.randint(0, 9) for _ in range(101)], "even": [rng.uniform(-5, 5) for _ in range(500)], "one": [7.0], "two": [1.0, 4.0], "ties": [2.0] * 40 + [3.0] * 40, None: [5.0, 6.0, 9.0]}
    rows = [(g, "k", float(v)) for g, vs in groups.items() for v in vs] + [("none", "k", None), ("two", "k", None)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(4)
    got = {r["g"]: (r["median"], r["n"]) for r in quantiles.exact_median(df, ["g", "h"], "v", slack).collect()}
    assert got == {g: (statistics.median(map(float, vs)), len(vs)) for g, vs in groups.items()}
    assert quantiles.exact_median(df.where("false"), ["g"], "v").count() == 0
