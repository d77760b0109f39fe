"""Operator 12: importance resampling towards a target distribution.

Features are hashed runs of words.  Their counts over the corpus and over the target texts give every bucket a gain, a
log ratio of the two smoothed shares; a text's weight is the sum of gains over its features, repeats counted; noise that
depends on the document alone (Gumbel, by a hash of its id) turns the highest scores into a draw without replacement in
proportion to exp(weight).

Identical texts are one row: texts are grouped whole, their features counted once and multiplied by the number of
documents, and the weight of a text is computed once and joined back by the text's digest before noise is added.  So a
text that a third of all documents have costs what one text costs.  The gains are one literal of ``buckets`` numbers.
Ranks come from a range sort on (score, id): rows are numbered inside each range and the ranges' sizes added up.

Defined cases: null text counts as empty; a text without a word has weight 0 and is never drawn; very long texts are
read whole; an id-less document is hashed as if its id were the empty text and comes last among ties; repeated ids are
rows like any other, each with a rank of its own; an empty target or corpus only leaves the smoothing; an empty table
gives an empty result.  Only ``doc_id`` and ``text`` of the corpus and ``text`` of the target are read, so other columns
may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: A word is a run of these, once A-Z are in lower case: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def features_of(words: Column, runs: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``runs`` consecutive words, repeats included."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def longer(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))).otherwise(none)

    none = F.array().cast("array<int>")
    return F.concat(F.transform(words, bucket), *[longer(n) for n in range(2, runs + 1)])


def collapsed(texts: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(digest, copies, n_words, features): every different text once."""
    whole = texts.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    with_words = whole.select(F.sha2("text", 256).alias("digest"), "copies", words_of(F.col("text")).alias("words"))
    return with_words.select("digest", "copies", F.size("words").alias("n_words"), features_of(F.col("words"), runs, buckets).alias("features"))


def bucket_counts(texts: DataFrame) -> dict[int, int]:
    """Features in each bucket over all copies of all texts; at most as many numbers as buckets."""
    found = texts.select("copies", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln) of the ratio of the smoothed shares of every bucket."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def weighted(documents: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    texts = materialize(collapsed(documents, runs, buckets), "texts")
    table = gains(bucket_counts(texts), bucket_counts(collapsed(target, runs, buckets)), buckets)
    gain = F.lit(table).cast("array<long>")
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, b: total + F.get(gain, b))
    weights = texts.select("digest", F.col("n_words").cast("long").alias("n_words"), F.size("features").cast("long").alias("n_features"), weight.alias("weight"))
    own = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return own.join(weights, "digest").drop("digest")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a global order, without a task that sees all of them."""
    sized = rows.repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    # Written once: the number's upper bits are the range, the lower ones the place in it.
    placed = materialize(sized.withColumn("_at", F.monotonically_increasing_id()), "placed")
    of = F.shiftright("_at", 33)
    sizes = {r["range"]: r["n"] for r in placed.groupBy(of.alias("range")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offset = F.get(F.lit(before or [0]).cast("array<long>"), of.cast("int"))
    return placed.withColumn(name, offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents of ``least_words`` words or more have a rank."""
    scored = weighted(documents, target, runs, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    placed = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id")]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
