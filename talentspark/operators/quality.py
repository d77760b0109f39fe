"""Findings rolled into weighted scores, writing style, sections, spelling and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def findings(df: DataFrame, id_col: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Long table of findings (id, category, code, severity) from rules (category, code, severity, condition)."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(g).alias("category"), F.lit(code).alias("code"), F.lit(s).alias("severity"))) for g, code, s, c in rules]))
    return df.select(id_col, F.explode(hits).alias("f")).select(id_col, "f.*")


def score(df: DataFrame, id_col: str, rules: list[tuple[str, str, str, Column]], weights: dict[str, int], chances: dict[str, int]) -> DataFrame:
    """Weighted score 0..100: per category (1 - (2 errors + warnings) / (2 chances)), truncated and clamped; integer mean."""
    total, weight = F.lit(0), sum(weights.values())
    parts = []
    for g, w in weights.items():
        count = lambda s, g=g: sum((F.when(c, 1).otherwise(0) for k, _, sev, c in rules if k == g and sev == s), F.lit(0))
        penalty = (2 * count("error") + count("warning")) / (2 * chances[g])
        s = F.greatest(F.lit(0), F.least(F.lit(100), F.floor((1 - penalty) * 100).cast("int")))
        parts.append(s.alias(f"{g}_score"))
        total = total + s * w
    return df.select(id_col, *parts, F.floor(total / weight).cast("int").alias("overall"))


def lexical_diversity(docs: DataFrame, id_col: str, least_words: int = 20) -> DataFrame:
    """Distinct share of words over two letters, for texts with enough of them."""
    w = docs.select(id_col, T.words(F.coalesce("text", F.lit("")), 3).alias("w"))
    return w.where(F.size("w") >= least_words).select(id_col, F.size("w").cast("long").alias("n_words"), (F.size(F.array_distinct("w")) / F.size("w")).alias("ttr"))


def stylometrics(docs: DataFrame, id_col: str, buzz: tuple[str, ...]) -> DataFrame:
    """Sentence lengths (mean, coefficient of variation) and buzzword density of each text."""
    s = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "[.!?]"), lambda x: F.size(T.words(x))), lambda n: n > 0)
    d = docs.select(id_col, s.alias("s"), T.words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("s") > 0)
    n = F.size("s")
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / n
    d = d.withColumn("mean_len", mean)
    var = F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("mean_len")) * (x - F.col("mean_len"))) / n
    hits = F.size(F.filter("w", lambda x: x.isin(*buzz)))
    return d.select(id_col, n.cast("long").alias("n_sentences"), "mean_len", (F.sqrt(var) / F.col("mean_len")).alias("cv"), (100 * hits / F.size("w")).alias("buzz_pct"))


def ai_likeness(buzz_pct: Column, cv: Column, ttr: Column) -> Column:
    """Style signals 0..100 blended by weights of those that are present."""
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))
    signals = [(0.25, clamp(buzz_pct / 5 * 100)), (0.15, clamp((1 - cv / 0.5) * 100)), (0.15, clamp((1 - ttr / 0.6) * 100))]
    top = sum((F.when(s.isNotNull(), w * s).otherwise(0.0) for w, s in signals), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in signals), F.lit(0.0))
    return F.when(weight > 0, F.floor(top / weight).cast("int"))


def sections(docs: DataFrame, id_col: str, heading: Column) -> DataFrame:
    """Lines with the heading they stand under: (id, pos, line, section); ``heading`` is a test of the column line."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def language_by_keywords(text: Column, lists: dict[str, tuple[str, ...]], least: int = 2, default: str = "en") -> Column:
    """Language with most different keywords present; under ``least`` hits the default; ties by the order given."""
    w = T.words(text)
    hits = {k: F.size(F.array_intersect(w, F.array(*map(F.lit, v)))) for k, v in lists.items()}
    most = F.greatest(*hits.values())
    out = F.lit(default)
    for k in reversed(list(hits)):
        out = F.when((hits[k] == most) & (most >= least), F.lit(k)).otherwise(out)
    return out


def weighted_pattern(text: Column, signals: dict[str, tuple[tuple[str, int], ...]]) -> Column:
    """struct(label, points) of the pattern with most points from the signals present; ties by the order given, null without a point."""
    points = {k: sum((F.when(text.contains(m), w).otherwise(0) for m, w in marks), F.lit(0)) for k, marks in signals.items()}
    most = F.greatest(*points.values(), F.lit(0))
    label = F.lit(None).cast("string")
    for k in reversed(list(points)):
        label = F.when(points[k] == most, F.lit(k)).otherwise(label)
    return F.when(most > 0, F.struct(label.alias("label"), most.alias("points")))


def misspelled(docs: DataFrame, id_col: str, known: DataFrame, shortest: int = 4) -> DataFrame:
    """Distinct words of each text that no known word equals."""
    w = docs.select(id_col, F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit("")), shortest))).alias("word"))
    return w.join(known.select("word").distinct(), "word", "left_anti").groupBy(id_col).agg(F.count("*").alias("unknown"))


def mentions(docs: DataFrame, id_col: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """Mentions of each kind in each text: (id, kind, n, different); ``patterns`` maps a kind to (pattern, least digits)."""
    text, found = F.coalesce("text", F.lit("")), []
    for kind, (pattern, least) in patterns.items():
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        if least:
            hits = F.filter(hits, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")) >= least)  # noqa: B023
        found.append(F.struct(F.lit(kind).alias("kind"), F.size(hits).cast("long").alias("n"), F.size(F.array_distinct(hits)).cast("long").alias("different")))
    return docs.select(id_col, F.explode(F.array(*found)).alias("m")).select(id_col, "m.*").where("n > 0")


#: Group of a finding by what its code contains, in order.
FINDING_GROUPS = [
    ("Achievements", ("bullet", "metric", "verb", "achievement", "quantity")),
    ("Sections", ("section", "missing")),
    ("Length", ("format", "length", "long", "short")),
    ("Contact", ("contact", "email", "phone")),
    ("Education", ("grad", "edu")),
]


def synthesis(found: DataFrame, id_col: str) -> DataFrame:
    """Findings(id, category, code, severity) in groups of advice: (id, group, errors, warnings, affected, important, rank).

    Groups of mere notes are left out; groups with an error come first, then the larger.
    """
    group = T.first_match(F.lower("code"), FINDING_GROUPS, "Other")
    group = F.when((group == "Length") & F.lower("category").contains("format"), "Formatting").otherwise(group)
    g = found.groupBy(id_col, group.alias("group")).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("affected"))
    g = g.where(F.col("errors") + F.col("warnings") > 0).withColumn("important", F.col("errors") > 0)
    w = Window.partitionBy(id_col).orderBy(F.desc("important"), F.desc("affected"), "group")
    return g.withColumn("rank", F.row_number().over(w))


#: Strong and weak first words of an achievement, buzzwords.
STRONG_VERBS = ("built", "led", "designed", "delivered", "drove", "launched", "reduced", "increased", "created", "improved", "managed", "developed")
WEAK_STARTS = ("helped", "assisted", "worked", "responsible", "participated", "involved")
BUZZWORDS = ("synergy", "go-getter", "team player", "think outside the box", "results-driven", "self-starter")


def lint_bullets(bullets: DataFrame, keys: list[str], strong: tuple[str, ...] = STRONG_VERBS, weak: tuple[str, ...] = WEAK_STARTS, buzz: tuple[str, ...] = BUZZWORDS, fillers: tuple[str, ...] = T.FILLERS) -> DataFrame:
    """Findings (keys, code, severity, n) of bullets(keys, text): opening verb, quantity, pronoun, buzzwords, fillers, length."""
    t, low = F.trim("text"), F.lower(F.trim("text"))
    words = F.filter(F.split(t, " "), lambda x: x != "")
    first = F.rtrim(F.lower(F.coalesce(F.get(words, 0), F.lit(""))), F.lit(".,;:"))
    n = F.size(words)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    count = lambda x, inside: sum((one(inside.contains(w)) for w in x), F.lit(0))
    rules = [
        ("WEAK_VERB", "warning", one(first.isin(*weak))), ("UNRECOGNISED_VERB", "info", one(~first.isin(*weak) & ~first.isin(*strong))),
        ("MISSING_QUANTITY", "warning", one(~t.rlike("[0-9]"))), ("PRONOUN", "error", one(padded.rlike(" (i|we|my|our|me) "))),
        ("BUZZWORD", "warning", count(buzz, low)), ("FILLER_WORD", "info", count([f" {f} " for f in fillers], padded)),
        ("BULLET_TOO_SHORT", "warning", one(n < 8)), ("BULLET_TOO_LONG", "info", one(n > 35)),
    ]
    hits = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), x.cast("long").alias("n")) for c, s, x in rules]), lambda x: x["n"] > 0)
    return bullets.select(*keys, F.explode(hits).alias("f")).select(*keys, "f.*")
