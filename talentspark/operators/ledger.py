"""Skill ledgers: interval-union experience, strength, views, merges, overrides, drift, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["entity", "skill"]


def _cover(rows: DataFrame, as_of: str, keys: list[str]) -> DataFrame:
    """The rows with ``_fresh`` (1 where a row begins a new range of its key's union) and ``_days`` (what it adds to the union's days).

    Rows without a start have null in both.
    """
    dated = F.col("start_date").isNotNull()
    rows = rows.withColumn("_stop", F.when(dated, F.coalesce("end_date", F.to_date(F.lit(as_of)))))
    before = F.max("_stop").over(Window.partitionBy(*keys).orderBy("start_date", "_stop").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before)
    fresh = F.col("_before").isNull() | (F.col("start_date") > F.col("_before"))
    added = F.when(fresh, F.datediff("_stop", "start_date")).otherwise(F.greatest(F.datediff("_stop", "_before"), F.lit(0)))
    return rows.withColumn("_fresh", F.when(dated, fresh.cast("int"))).withColumn("_days", F.when(dated, added)).drop("_stop", "_before")


def interval_union(evidence: DataFrame, as_of: str, keys: list[str] = KEY) -> DataFrame:
    """Days covered by the union of date ranges a key (touching ranges merge, an open end is ``as_of``)."""
    rows = evidence.where(F.col("start_date").isNotNull()).select(*keys, "start_date", "end_date")
    return _cover(rows, as_of, keys).groupBy(*keys).agg(F.sum("_fresh").alias("islands"), F.sum("_days").alias("days"))


def strength(years: Column, roles: Column, is_current: Column, last_seen: Column, confidence: Column, as_of: str) -> Column:
    age = F.datediff(F.to_date(F.lit(as_of)), last_seen)
    recency = F.when(is_current, 1.0).when(last_seen.isNull(), 0.3).otherwise(F.greatest(F.lit(0.0), 1 - age / 1825))
    return 0.3 * F.least(years / 10, F.lit(1.0)) + 0.25 * F.least(roles / 5, F.lit(1.0)) + 0.25 * recency + 0.2 * confidence


def build_ledger(evidence: DataFrame, as_of: str) -> DataFrame:
    """One entry a (entity, skill): counts, first and last seen, years of the interval union, strength.

    A missing experience counts as one role; last_seen is the end of the evidence that starts latest.  The evidence is
    shuffled once, by (entity, skill), for all of it; where it is dealt by entity before, not again.
    """
    role = F.coalesce(F.col("experience"), F.lit(-1))
    again = F.lag(role).over(Window.partitionBy(*KEY).orderBy(role)).eqNullSafe(role)
    ledger = _cover(evidence.withColumn("_role", (~again).cast("int")), as_of, KEY).groupBy(*KEY).agg(
        F.count("*").alias("evidence_count"), F.min("start_date").alias("first_seen"),
        F.max(F.struct("start_date", "experience", "seq", "end_date"))["end_date"].alias("last_seen"),
        F.max(F.col("end_date").isNull()).alias("is_current"),
        F.sum("_role").alias("role_count"),
        F.max("confidence").alias("max_confidence"), F.min("category").alias("category"),
        F.every(F.col("source") == "N").alias("all_listed"), (F.coalesce(F.sum("_days"), F.lit(0)) / 365.25).alias("years"),
    )
    # Listed only, and by one piece of evidence.
    ledger = ledger.withColumn("unsubstantiated", F.col("all_listed") & (F.col("evidence_count") == 1)).drop("all_listed")
    score = strength(F.col("years"), F.col("role_count"), F.col("is_current"), F.col("last_seen"), F.col("max_confidence"), as_of)
    return ledger.withColumn("strength", score)


def level(s: Column) -> Column:
    return F.when(s > 0.5, "strong").when(s > 0.1, "weak").otherwise("trace")


def compound(ledgers: list[DataFrame], as_of: str) -> DataFrame:
    """Evidence of several ledgers merged, repeated (entity, skill, experience, start) dropped, and re-aggregated."""
    merged = ledgers[0]
    for more in ledgers[1:]:
        merged = merged.unionByName(more)
    w = Window.partitionBy("entity", "skill", "experience", "start_date").orderBy("seq", "confidence", "end_date", "source", "category")
    return build_ledger(merged.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"), as_of)


def override(evidence: DataFrame, dismissed: DataFrame, renamed: DataFrame, manual: DataFrame) -> DataFrame:
    """Dismissed skills go, renamed skills (skill, new_name) move, manual evidence is added."""
    kept = evidence.join(dismissed.select("skill"), "skill", "left_anti").join(renamed, "skill", "left")
    kept = kept.withColumn("skill", F.coalesce("new_name", "skill")).drop("new_name")
    return kept.unionByName(manual.select(*kept.columns))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer comparison of two ledgers by (entity, skill)."""
    a = before.select(*KEY, F.col("strength").alias("s0"), F.col("years").alias("y0"))
    b = after.select(*KEY, F.col("strength").alias("s1"), F.col("years").alias("y1"))
    ds, dy = F.col("s1") - F.col("s0"), F.col("y1") - F.col("y0")
    small = (F.abs(ds) < 0.05) & (F.abs(dy) < 0.5)
    up = F.when(F.abs(ds) >= 0.05, ds > 0).otherwise(dy > 0)
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "dropped").when(small, "same").when(up, "strengthened").otherwise("weakened")
    return a.join(b, KEY, "full_outer").withColumn("change", change)


def stale(ledger: DataFrame, as_of: str, days: int = 1825) -> DataFrame:
    return ledger.where(~F.col("is_current") & (F.datediff(F.to_date(F.lit(as_of)), F.col("last_seen")) > days))


def overclaimed(ledger: DataFrame, claims: DataFrame, share: float = 0.7, within: int = 30) -> DataFrame:
    """Entries whose years fall short of ``share`` of the years claimed in claims(entity, skill, text).

    A claim is a number of years in the ``within`` characters before the first mention of the skill;
    the largest claim of a skill counts.
    """
    at = F.instr(F.lower("text"), F.lower("skill"))
    before = F.substring(F.col("text"), F.greatest(at - within, F.lit(1)), F.least(at - 1, F.lit(within)))
    c = claims.where(at > 1).withColumn("claimed", T.claimed_years(before)).groupBy(*KEY).agg(F.max("claimed").alias("claimed"))
    return ledger.join(c, KEY).where(F.round("years", 6) < F.round(F.col("claimed") * share, 6))


def issues(ledger: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """Consistency issues (entity, skill, issue) of all three kinds: listed only, overclaimed years, stale."""
    parts = [("unsubstantiated", ledger.where("unsubstantiated")), ("overclaimed", overclaimed(ledger, claims)), ("stale", stale(ledger, as_of))]
    tagged = [df.select(*KEY, F.lit(kind).alias("issue")) for kind, df in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def radar(ledger: DataFrame, k: int = 8) -> DataFrame:
    """The k strongest skills of each entity, strongest first."""
    w = Window.partitionBy("entity").orderBy(F.round("strength", 6).desc(), "skill")
    return ledger.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relevant_roles(evidence: DataFrame, matched: DataFrame, recent: int = 3) -> DataFrame:
    """(entity, experience, relevant, age): experiences with evidence of a matched(entity, skill), and the ``recent`` latest."""
    role = evidence.join(matched.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left").groupBy("entity", "experience").agg(F.max("start_date").alias("started"), F.max(F.coalesce("hit", F.lit(0))).alias("relevant"))
    w = Window.partitionBy("entity").orderBy(F.desc("started"), F.desc("experience"))
    return role.withColumn("age", F.row_number().over(w)).where((F.col("relevant") == 1) | (F.col("age") <= recent)).select("entity", "experience", "relevant", "age")


def tailoring_prompt(job: Column, skills: Column, bullets: Column) -> Column:
    """Prompt text from a job title and arrays of skills and bullets."""
    lines = F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Target role: "), job), F.concat(F.lit("Skills: "), F.array_join(skills, ", ")), F.lit("Evidence:"), lines)


def repository_strength(size_kb: Column, skills: Column, stars: Column, idle_days: Column) -> Column:
    """Size, skills and stars, each up to a ceiling, and the time since the last push."""
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    recency = F.when(idle_days < 365, 1.0).when(idle_days < 730, 0.7).otherwise(0.4)
    return 0.25 * part(size_kb, 10000) + 0.3 * part(skills, 10) + 0.2 * part(stars, 20) + 0.25 * recency


def byte_shares(sizes: DataFrame, key: str, item: str, size: str, least: float = 0.05) -> DataFrame:
    """(key, item, share, confidence) of each item's share of its key's bytes, from ``least`` on; half as much again, and 0.1, as evidence."""
    total = sizes.groupBy(key).agg(F.sum(size).alias("_total"))
    x = sizes.groupBy(key, item).agg(F.sum(size).alias("_size")).join(total, key).withColumn("share", F.col("_size") / F.col("_total"))
    confidence = F.least(F.lit(0.95), F.least(F.lit(1.0), F.col("share") * 1.5) + 0.1)
    return x.where(F.col("share") >= least).select(key, item, "share", confidence.alias("confidence"))


def top_evidence(evidence: DataFrame, k: int = 3) -> DataFrame:
    """The k best pieces of evidence of each entry: confidence, then the latest start."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("confidence"), F.desc("start_date"), "experience", "seq")
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gantt(evidence: DataFrame, as_of: str) -> DataFrame:
    """Offset and width of each experience in percent of its entity's career."""
    spans = evidence.groupBy("entity", "experience").agg(F.min("start_date").alias("a"), F.max(F.coalesce("end_date", F.to_date(F.lit(as_of)))).alias("b"))
    w = Window.partitionBy("entity")
    whole = F.greatest(F.datediff(F.max("b").over(w), F.min("a").over(w)), F.lit(1))
    return spans.select(
        "entity", "experience", (100 * F.datediff("a", F.min("a").over(w)) / whole).alias("offset_pct"), F.greatest(F.lit(1.0), 100 * F.datediff("b", "a") / whole).alias("width_pct")
    )
