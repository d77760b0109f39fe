"""Keyed and near-duplicate removal, reposts, overlap merges, fusion of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.writers import written
from .graph import connected
from .matching import contained


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order (partial limits run before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_by_nonempty(df: DataFrame, key: str, seq: str) -> DataFrame:
    """First row a key; rows with an empty or null key all stay."""
    has = F.coalesce(F.col(key) != "", F.lit(False))
    return latest_per_key(df.where(has), [key], [F.col(seq)]).unionByName(df.where(~has))


def overlapping(rows: DataFrame, key: str, grace_days: int = 90, bucket_days: int = 365) -> DataFrame:
    """Pairs (a_id < b_id) of a key whose date ranges overlap within a grace: ranges meet in time buckets."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    x = rows.select(F.col(key).alias("k"), "id", day(F.col("start_date")).alias("s"), (day(F.col("stop")) + grace_days).alias("e"))
    x = x.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / bucket_days), F.floor(F.col("e") / bucket_days))))
    y = x.select("k", "bucket", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    first = F.col("bucket") == F.floor(F.greatest("s", "s2") / bucket_days)
    hit = x.join(y, ["k", "bucket"]).where((F.col("id") < F.col("id2")) & (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) & first)
    return hit.select(F.col("k").alias(key), F.col("id").alias("a_id"), F.col("id2").alias("b_id"))


def similar_titles(titles: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(company, a, b) of distinct titles(company, title) of a company, a = b included, whose common words exceed
    ``threshold`` of the larger word set.

    Two such titles share one of the first n - floor(threshold n) words of either in order of rarity,
    so titles meet on these words only.
    """
    t = titles.select("company", "title").distinct().withColumn("w", F.array_distinct(F.filter(F.split(F.lower("title"), " +"), lambda x: x != "")))
    words = t.where(F.size("w") > 0).select("company", "title", F.size("w").alias("n"), F.explode("w").alias("word"))
    rare = words.join(words.groupBy("company", "word").agg(F.count("*").alias("titles")), ["company", "word"])
    at = F.row_number().over(Window.partitionBy("company", "title").orderBy("titles", "word"))
    first = rare.withColumn("at", at).where(F.col("at") <= F.col("n") - F.floor(F.col("n") * threshold + 1e-9)).select("company", "title", "word")
    met = first.join(first.select("company", F.col("title").alias("title2"), "word"), ["company", "word"]).select("company", "title", "title2").distinct()
    other = t.select("company", F.col("title").alias("title2"), F.col("w").alias("w2"))
    both = met.join(t, ["company", "title"]).join(other, ["company", "title2"])
    similarity = F.size(F.array_intersect("w", "w2")) / F.greatest(F.size("w"), F.size("w2"))
    return both.where(similarity > threshold + 1e-9).select("company", F.col("title").alias("a"), F.col("title2").alias("b"))


def reposts(jobs: DataFrame, within_days: int = 60, least: int = 3, threshold: float = 0.7) -> DataFrame:
    """Each posting that follows a similar one of its company: the company's postings, days since the nearest, likely posted for show.

    Companies are compared without case; of postings of one day the larger id is the newer.
    """
    j = jobs.where(F.col("company") != "").select("job_id", F.lower("company").alias("company"), "title", "created")
    sizes = j.groupBy("company").agg(F.count("*").alias("posts"))
    linked = similar_titles(j, threshold)
    # Every posting among those of the titles similar to its own, in order of time.
    seen = j.join(linked.withColumnRenamed("b", "title"), ["company", "title"])
    w = Window.partitionBy("company", "a").orderBy("created", "job_id")
    gap = F.datediff("created", F.lag("created").over(w))
    own = seen.withColumn("days", gap).where((F.col("a") == F.col("title")) & F.col("days").isNotNull())
    likely = (F.col("days") < within_days) & (F.col("posts") >= least)
    return own.join(sizes, "company").select("job_id", "company", "title", "posts", "days", likely.alias("likely"))


def set_classes(sets: DataFrame) -> DataFrame:
    """Equal sets(id, items) as one row: items, the smallest id and how many there are.  Items are distinct."""
    return sets.groupBy(F.array_sort("items").alias("items")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _marks(items: str, words: int = 2) -> list[Column]:
    """``words`` longs with a bit set for each item of an array: a bit of one set that another lacks is an item the other lacks."""
    at = f"pmod(xxhash64(x), {64 * words})"
    return [F.expr(f"aggregate({items}, 0L, (a, x) -> CASE WHEN {at} DIV 64 = {i} THEN a | shiftleft(1L, cast({at} % 64 AS int)) ELSE a END)").alias(f"mark{i}") for i in range(words)]


def jaccard_candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (id < id2) of different sets(id, items) that may reach the threshold; every pair that does is among them.

    Sets meet on the rarest items only: two sets that similar share one of their first
    n - ceil(threshold * n) + 1 items in order of frequency.  Where they meet, their sizes and
    marks say how many items they can share at most, before any pair is shuffled.
    """
    marks = _marks("items")
    e = classes.select("id", F.size("items").alias("n"), *marks, F.explode("items").alias("item"))
    frequent = e.groupBy("item").agg(F.count("*").alias("sets"))
    w = Window.partitionBy("id").orderBy("sets", "item")
    first = e.join(frequent, "item").withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    first = first.select("id", "n", "item", *[f"mark{i}" for i in range(len(marks))])
    met = first.join(first.select("item", *[F.col(x).alias(f"{x}2") for x in first.columns if x != "item"]), "item")
    shared = lambda n, x, y: F.col(n) - sum(F.bit_count(F.col(f"mark{i}{x}").bitwiseAND(F.bitwise_not(f"mark{i}{y}"))) for i in range(len(marks)))
    most = F.least(shared("n", "", "2"), shared("n2", "2", ""))
    near = (F.least("n", "n2") >= threshold * F.greatest("n", "n2") - 1e-9) & (most >= threshold * (F.col("n") + F.col("n2") - most) - 1e-9)
    return met.where((F.col("id") < F.col("id2")) & near).select("id", "id2").distinct()


def jaccard(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (id < id2) of classes of equal sets with Jaccard similarity of at least the threshold.

    A common item brings sets together only where all their items are common (see ``jaccard_candidates``), and equal
    sets are one row by then.
    """
    c = set_classes(sets).where(F.size("items") > 0)
    met = jaccard_candidates(c, threshold)
    both = met.join(c.select("id", "items"), "id").join(c.select(F.col("id").alias("id2"), F.col("items").alias("items2")), "id2")
    common = F.size(F.array_intersect("items", "items2"))
    both = both.withColumn("similarity", common / (F.size("items") + F.size("items2") - common))
    return both.where(F.col("similarity") >= threshold).select("id", "id2", "similarity")


def jaccard_pairs(sets: DataFrame, threshold: float, block: int = 1000) -> DataFrame:
    """All pairs (id < id2) of sets(id, items) with Jaccard similarity of at least the threshold, equal sets among them.

    Classes of equal sets meet as in ``jaccard``; their members then meet in blocks of about ``block``, so a task
    holds no more of a large class at once.  Empty sets have no pair.
    """
    c = set_classes(sets).where(F.size("items") > 0).withColumn("blocks", F.ceil(F.col("copies") / block).cast("int"))
    at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    own = c.select("items", F.col("id").alias("class"), "blocks")
    m = sets.select("id", F.array_sort("items").alias("items")).join(own, "items").select("class", "id", at.alias("at"))
    met = jaccard(sets, threshold).unionByName(c.where("copies > 1").select("id", F.col("id").alias("id2"), F.lit(1.0).alias("similarity")))
    n = lambda side: c.select(F.col("id").alias(f"id{side}"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"at{side}"))
    met = met.join(n(""), "id").join(n("2"), "id2").where((F.col("id") != F.col("id2")) | (F.col("at") <= F.col("at2"))).select(F.col("id").alias("class"), "at", F.col("id2").alias("class2"), "at2", "similarity")
    x = met.join(m, ["class", "at"]).join(m.select(F.col("class").alias("class2"), F.col("at").alias("at2"), F.col("id").alias("other")), ["class2", "at2"])
    # Two blocks of one class meet once, a block meets itself in both orders.
    twice = (F.col("class") == F.col("class2")) & (F.col("at") == F.col("at2")) & (F.col("id") >= F.col("other"))
    return x.where(~twice).select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("id2"), "similarity")


def jaccard_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Each set with the smallest id of its equals and the number of other sets it is similar to."""
    c = set_classes(sets)
    p = jaccard(sets, threshold).select("id", "id2")
    p = p.unionByName(p.select(F.col("id2").alias("id"), F.col("id").alias("id2")))
    near = p.join(c.select(F.col("id").alias("id2"), "copies"), "id2").groupBy("id").agg(F.sum("copies").alias("near"))
    c = c.join(near, "id", "left").select("items", F.col("id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return sets.select("id", F.array_sort("items").alias("items")).join(c, "items").select("id", "class_id", "n_links")


def fuse(candidates: DataFrame, keys: list[str], boost: float = 0.1) -> DataFrame:
    """Candidates(keys.., value, source, confidence): per normalised value max confidence + boost a further source, capped at 1; rank within keys."""
    norm = F.translate(F.lower(F.trim("value")), ".,()", "")
    g = candidates.withColumn("norm", norm).groupBy(*keys, "norm").agg(F.max("confidence").alias("c"), F.countDistinct("source").alias("sources"), F.max_by("value", F.struct("confidence", "value")).alias("value"))
    g = g.withColumn("confidence", F.least(F.lit(1.0), F.col("c") + boost * (F.col("sources") - 1)))
    w = Window.partitionBy(*keys).orderBy(F.round("confidence", 9).desc(), "norm")
    return g.withColumn("rank", F.row_number().over(w)).drop("c")


def not_subsumed(incoming: Column, existing: Column) -> Column:
    """Strings of an array that neither contain nor are contained in a string of the other array."""
    return F.filter(incoming, lambda x: ~F.exists(existing, lambda y: x.contains(y) | y.contains(x)))


def profile(rows: DataFrame, key: str, seq: str, longest: str, first: list[str], most: list[str]) -> DataFrame:
    """One aggregate a key: longest text, first non-null values by seq, largest numbers."""
    return rows.groupBy(key).agg(
        F.max_by(longest, F.struct(F.length(longest), longest)).alias(longest),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first], *[F.max(c).alias(c) for c in most],
    )


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version of every key over both tables; of equal versions the new table's row, then the first in order of all columns."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.col(c) for c in sorted(old.columns) if c not in (key, version)]
    return latest_per_key(both, [key], [F.col(version).desc(), F.col("_new").desc(), *rest]).drop("_new")


def merged_spells(rows: DataFrame, keys: list[str], longest: str, grace_days: int = 90) -> DataFrame:
    """Date ranges of each key as one row where they follow within a grace: first start, last stop, longest text, how many.

    A merged range grows as ranges join it, whatever order they come in.
    """
    w = Window.partitionBy(*keys).orderBy("start_date", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.datediff("start_date", before) > grace_days)).cast("int")
    x = rows.withColumn("_fresh", fresh).withColumn("_spell", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.max_by(longest, F.struct(F.length(longest), longest)).alias(longest)
    return x.groupBy(*keys, "_spell").agg(F.min("start_date").alias("start_date"), F.max("stop").alias("stop"), text, F.count("*").alias("n")).drop("_spell")


def similar_names(names: DataFrame) -> DataFrame:
    """(part, whole) of different normalised names (one column) where all words of one stand, in a row, in the other."""
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return contained(names, names).where((F.col("part") != F.col("whole")) & spaced("whole").contains(spaced("part")))


def merged_similar(rows: DataFrame, key: str, name: str, grace_days: int = 90, bucket_days: int = 365) -> DataFrame:
    """Spells (key, start_date, stop, name, names, n) of rows(key, name, start_date, stop) whose names are alike and whose dates touch.

    Company names are alike when they are equal after normalising or one holds the other's words.  Spells of one
    name are merged first; those of names alike within the grace are linked by name and time bucket, and what
    links connect is one spell, so a chain of near names and touching dates ends as one row with the longest name.
    Rows without a name or a start join nothing and stay as they are, with n = 1.
    """
    norm = T.normalise_company(F.col(name))
    rows = rows.select(key, name, "start_date", "stop", F.coalesce(norm, F.lit("")).alias("_norm"))
    usable = (F.col("_norm") != "") & F.col("start_date").isNotNull() & F.col("stop").isNotNull() & F.col(key).isNotNull()
    spells = merged_spells(rows.where(usable), [key, "_norm"], name, grace_days)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    # Written with their numbers: what meets below is numbers only.
    spells = written(spells.withColumn("_id", F.monotonically_increasing_id()).withColumn("s", day(F.col("start_date"))).withColumn("e", day(F.col("stop")) + grace_days), "spells")
    names = written(spells.select("_norm").distinct().withColumn("_number", F.monotonically_increasing_id()), "names")
    number = lambda c: names.select(F.col("_norm").alias(c), F.col("_number").alias(f"{c}_number"))
    alike = similar_names(names.select("_norm")).join(number("part"), "part").join(number("whole"), "whole")
    alike = written(alike.select(F.col("part_number").alias("part"), F.col("whole_number").alias("whole")), "alike")
    numbered = spells.join(names, "_norm").select(key, F.col("_number").alias("_name"), "_id", "s", "e")
    buckets = F.explode(F.sequence(F.floor(F.col("s") / bucket_days), F.floor(F.col("e") / bucket_days))).alias("bucket")
    # A name holds few others but may be in very many, so it is the longer one that looks for its parts.
    x = numbered.join(alike.select("part").distinct(), F.col("_name") == F.col("part"), "left_semi").select(key, F.col("_name").alias("part"), F.col("_id").alias("u"), "s", "e", buckets)
    y = numbered.join(alike, F.col("_name") == F.col("whole")).select(key, "part", F.col("_id").alias("v"), F.col("s").alias("s2"), F.col("e").alias("e2"), buckets)
    first = F.col("bucket") == F.floor(F.greatest("s", "s2") / bucket_days)
    links = x.join(y, [key, "bucket", "part"]).where((F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) & first).select("u", "v")
    part = connected(links)
    out = spells.join(part, F.col("_id") == F.col("node"), "left").groupBy(key, F.coalesce("component", "_id").alias("_c")).agg(
        F.min("start_date").alias("start_date"), F.max("stop").alias("stop"), F.max_by(name, F.struct(F.length(name), name)).alias(name), F.countDistinct("_norm").alias("names"), F.sum("n").alias("n")
    )
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select(key, "start_date", "stop", name, F.lit(1).alias("names"), F.lit(1).alias("n"))
    return out.drop("_c").unionByName(alone)


def merge_named(existing: DataFrame, incoming: DataFrame, key: str, name: str, similar: DataFrame | None = None) -> DataFrame:
    """Incoming rows of a key with the existing name they join: equal without case, else the first by name in similar(name, other); null if new."""
    low = existing.select(key, F.lower(name).alias("_low"), F.col(name).alias("into")).groupBy(key, "_low").agg(F.min("into").alias("into"))
    x = incoming.withColumn("_low", F.lower(name))
    out = x.join(low, [key, "_low"], "left")
    if similar is not None:
        s = similar.select(F.lower("name").alias("_low"), F.lower("other").alias("_other")).distinct()
        near = x.select(key, "_low").distinct().join(s, "_low").join(low.select(key, F.col("_low").alias("_other"), F.col("into").alias("near")), [key, "_other"])
        near = near.groupBy(key, "_low").agg(F.min("near").alias("near"))
        out = out.join(near, [key, "_low"], "left").withColumn("into", F.coalesce("into", "near")).drop("near")
    return out.drop("_low")


def fuse_names(candidates: DataFrame, key: str, boost: float = 0.1) -> DataFrame:
    """The name of each key from candidates(key, name, source, confidence): most confident after a boost a further source, then most sources.

    A name some recogniser (source NER) found that begins a longer name-like candidate gives way to
    that one; what does not look like a name has a confidence of 0.3 at most.
    """
    low = F.lower(F.trim("name"))
    g = candidates.withColumn("norm", low).groupBy(key, "norm").agg(
        F.max_by("name", F.struct("confidence", "name")).alias("name"), F.max("confidence").alias("c"), F.countDistinct("source").alias("sources"), F.max((F.col("source") == "NER").cast("int")).alias("ner")
    )
    g = g.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("c") + boost * (F.col("sources") - 1)), 6))
    order = lambda *p: F.struct(*[(-F.col(f"{x}confidence")).alias("a") for x in p], *[(-F.col(f"{x}sources")).alias("b") for x in p], *[F.col(f"{x}norm").alias("n") for x in p])
    row = F.struct("name", "confidence")
    best = g.groupBy(key).agg(F.min_by(row, order("")).alias("best"))
    other = g.select(key, *[F.col(c).alias("l_" + c) for c in ("norm", "name", "confidence", "sources")])
    longer = g.where("ner = 1").join(other, key).where((F.col("l_norm") != F.col("norm")) & F.col("l_norm").startswith(F.col("norm")) & T.is_name_like(F.col("l_name")))
    longer = longer.groupBy(key).agg(F.min_by(F.struct("l_name", "l_confidence"), F.struct(order("").alias("x"), order("l_").alias("y"))).alias("longer"))
    out = best.join(longer, key, "left").select(key, F.coalesce("longer.l_name", "best.name").alias("name"), F.coalesce("longer.l_confidence", "best.confidence").alias("confidence"))
    sure = T.is_name_like(F.col("name")) & (F.length("name") >= 4)
    return out.withColumn("confidence", F.when(sure, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.3))))
