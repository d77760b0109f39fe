"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_median(df: DataFrame, keys: list[str], value: str, slack: float = 0.005, accuracy: int = 10_000) -> DataFrame:
    """(keys, median, n): the mean of the middle value or the two middle values of each group, nulls left out.

    A sketch of bounded size gives each group a narrow range that holds its middle (its rank error is at most
    1 / ``accuracy``, far below ``slack``); rows under the range are only counted, different values inside it are counted
    and ranked.  No buffer holds a group's values.  Null keys are a group of their own.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    around = rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)), accuracy).alias("_r"), F.count("*").alias("n"))
    around = around.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r")[0].alias("_lo"), F.col("_r")[1].alias("_hi"), "n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = rows.join(around, same)
    # What lies under the range is one value each group, in its right place.
    counted = placed.where("_v <= _hi").groupBy(*keys, "n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", upto).where("_v IS NOT NULL")
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    at = lambda r: F.min(F.when(F.col("_upto") >= r, F.col("_v")))
    return ranked.groupBy(*keys, "n").agg(((at(first) + at(second)) / 2).alias("median")).select(*keys, "median", "n")
