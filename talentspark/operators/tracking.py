"""Application tracking: vote folds, the stage machine, funnels, ghosting, mail classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = (5, 6, 7, 8)

#: Mail rules in order, the first match wins (fixed values).
MAIL_RULES = (
    ("Offer", 0.9, ("pleased to offer", "job offer", "offer letter")),
    ("Interview", 0.8, ("interview", "schedule a call", "phone screen")),
    ("Rejected", 0.85, ("unfortunately", "not moving forward", "other candidates")),
    ("Screening", 0.75, ("assessment", "screening", "coding challenge")),
    ("Applied", 0.7, ("received your application", "thank you for applying")),
)


def _by_day(df: DataFrame, key: list[str], *values: str) -> DataFrame:
    """Events of each key and day as one array in (ts, seq) order; days are folded first, so no array holds a whole log."""
    return df.groupBy(*key, F.to_date("ts").alias("_day")).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", *values))).alias("log"))


def vote_fold(votes: DataFrame, key: list[str], least: int = -5, most: int = 5) -> DataFrame:
    """Running sum of +1 / -1 clamped at every step.

    A run of clamped steps is itself a shift between two limits, so each day becomes one such
    step (shift, low, high), and the days of a key are applied in order.
    """
    clamp = lambda x: F.greatest(F.lit(least), F.least(F.lit(most), x))
    whole = F.struct(F.lit(0).alias("shift"), F.lit(-(1 << 30)).alias("low"), F.lit(1 << 30).alias("high"))
    step = lambda s, x: F.struct((s["shift"] + x["delta"]).alias("shift"), clamp(s["low"] + x["delta"]).alias("low"), clamp(s["high"] + x["delta"]).alias("high"))
    days = _by_day(votes, key, "delta").select(*key, F.struct("_day", F.aggregate("log", whole, step).alias("f")).alias("d"))
    apply = lambda x, d: F.least(d["f"]["high"], F.greatest(d["f"]["low"], x + d["f"]["shift"]))
    return days.groupBy(*key).agg(F.array_sort(F.collect_list("d")).alias("days")).select(*key, F.aggregate("days", F.lit(0), apply).alias("score"))


def auto_filter(scores: DataFrame, at: int = -3) -> DataFrame:
    """Aspect values voted down far enough to be filtered out."""
    return scores.where(F.col("score") <= at)


def stage_step(stage: Column, to: Column) -> Column:
    """Forward only, terminal stages stay, Accepted is never set automatically."""
    return F.when(stage.isin(*TERMINAL) | (to == 5) | (to <= stage), stage).otherwise(to)


def stage_fold(events: DataFrame, key: list[str], stages: int = 9) -> DataFrame:
    """Final stage, time of the first Applied or later event and last activity of each application.

    The events of a day become one map from stage to stage; the maps of an application are applied in order.
    """
    same = F.array(*map(F.lit, range(stages)))
    fold = F.aggregate("log", same, lambda m, x: F.transform(m, lambda s: stage_step(s, x["to_stage"])))
    days = _by_day(events, key, "to_stage").select(
        *key, F.struct("_day", fold.alias("map")).alias("d"), F.get(F.filter("log", lambda x: x["to_stage"] >= 1), 0)["ts"].alias("applied_at"),
        F.element_at("log", -1)["ts"].alias("last_activity"), F.size("log").alias("n_events"),
    )
    whole = days.groupBy(*key).agg(F.array_sort(F.collect_list("d")).alias("days"), F.min("applied_at").alias("applied_at"), F.max("last_activity").alias("last_activity"), F.sum("n_events").cast("long").alias("n_events"))
    return whole.select(*key, F.aggregate("days", F.lit(0), lambda s, d: F.get(d["map"], s)).alias("stage"), "applied_at", "last_activity", "n_events")


def funnel(applications: DataFrame) -> DataFrame:
    """Count and share of each stage that occurs."""
    w = Window.partitionBy()
    g = applications.groupBy("stage").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def rates(applications: DataFrame) -> DataFrame:
    """Integer percentages over applications at Applied or beyond."""
    s = F.col("stage")
    n = applications.agg(
        F.count_if(s >= 1).alias("applied"), F.count_if((s > 1) & (s != 8)).alias("responded"), F.count_if(s.isin(3, 4, 5)).alias("interviews"), F.count_if(s.isin(4, 5)).alias("offers"), F.count("*").alias("total")
    )
    pct = lambda c: F.expr(f"cast(case when applied = 0 then 0 else 100 * {c} div applied end as long)")
    return n.select("total", "applied", pct("responded").alias("response_rate"), pct("interviews").alias("interview_rate"), pct("offers").alias("offer_rate"))


def ghosted(applications: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Applied and without activity for ``days`` or more."""
    return applications.where((F.col("stage") == 1) & (F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_activity")) >= days))


def watch_due(watches: DataFrame, as_of: str) -> DataFrame:
    """Active, with an interval, and never polled or polled at least an interval ago."""
    elapsed = F.datediff(F.to_date(F.lit(as_of)), "last_polled")
    due = F.col("active") & (F.col("interval_days") > 0) & (F.col("last_polled").isNull() | (elapsed >= F.col("interval_days")))
    return watches.withColumn("due", F.coalesce(due, F.lit(False)))


def classify_mail(text: Column) -> Column:
    """struct(label, confidence) of the first rule that matches."""
    out = F.when(text.contains("application"), F.struct(F.lit("Other").alias("label"), F.lit(0.4).alias("confidence")))
    for label, confidence, marks in reversed(MAIL_RULES):
        hit = F.lit(False)
        for m in marks:
            hit = hit | text.contains(m)
        out = F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def notifications(found: DataFrame, k: int = 3) -> DataFrame:
    """Per watch of found(watch, job_id, score, title): how many jobs are new, and the titles of the k best in order."""
    w = Window.partitionBy("watch").orderBy(F.desc("score"), "job_id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("watch").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t"))
    n = found.groupBy("watch").agg(F.count("*").alias("n"))
    return n.join(top, "watch").select("watch", "n", F.array_join(F.transform("t", lambda x: x["title"]), "; ").alias("top"))
