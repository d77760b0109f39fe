"""Operator 5: document quality rules as one Spark projection (no user functions).

A threshold table (measure, least, most, from how many words on) is compiled into one
boolean column over measures of length, symbols, stop words and lines; the measures are
built-in array and string expressions.  Repeated five-word windows are found through
64-bit hashes of the windows of one text; a text without an equal pair of hashes, which
is nearly every text, needs no more than that.  In the others the windows themselves are
compared.

Defined cases: null text has no words; texts under ten words or with many repeated words
fail the base rule; a measure equal to a limit holds; ratios of a text without words are
null and pass no verdict; very long texts are measured whole; null and repeated ids are
rows like any other, judged one by one; an empty table gives an empty result.  Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on as with was be by this are or from not have "
    "der die und zu den das nicht von sie ist des sich mit dem er auf eine auch für im "
    "de la le et les un du une que est pour qui dans au par pas plus sur avec "
    "el los del las por con para su al lo como pero y se en"
).split()


@dataclass(frozen=True)
class Rule:
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The method's verdict: all of these hold.
RULES = (
    Rule("mean_word", 1.5, 25.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("duplicate_lines", None, 0.5, 30),
    Rule("stop_words", 2, None, 60),
    Rule("marked_lines", None, 0.9, 50),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: every rule holds or the text has fewer words than the rule asks for."""
    verdict = F.lit(True)
    for r in rules:
        x = F.col(r.measure)
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (x >= r.least)
        if r.most is not None:
            ok = ok & (x <= r.most)
        verdict = verdict & (ok if not r.from_words else (F.col("n_words") < r.from_words) | ok)
    return F.coalesce(verdict, F.lit(False))


def _twice(marked: str) -> Column:
    """Positions whose window equals a neighbour's in the array column of sorted (window, position)."""
    same = lambda s, i: F.coalesce(F.get(marked, i)["h"] == s["h"], F.lit(False))
    flagged = F.transform(marked, lambda s, i: F.when(same(s, i - 1) | same(s, i + 1), s["p"]))
    return F.sort_array(F.filter(flagged, lambda p: p.isNotNull()))


def _covered(at: str, size: int) -> Column:
    """Words inside windows that start at these sorted positions: each covers up to the next start."""
    return F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p - acc["last"])).cast("long").alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def measures(documents: DataFrame, window: int = 5) -> DataFrame:
    """All measures of every whole text, one row a document."""
    text = F.coalesce("text", F.lit(""))
    df = documents.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.array_remove(F.split("text", BLANKS), "").alias("words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    df = df.select(
        "doc_id", "n_symbols", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*(?:[-*•]|[0-9]+[.)])\s"))).alias("n_marked"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))).alias("stop_words"),
        F.when(
            F.size("words") >= window,
            F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    # Array columns that lambdas look into are columns of their own: a lambda would build an expression anew for each element.
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_marked", "stop_words"]
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # Words hold no blank, so windows joined by blanks are equal only if their words are.
    numbered = F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.struct(F.array_join(F.slice("words", i + 1, window), " ").alias("h"), i.alias("p")))
    df = df.select(*kept, F.when(repeats, F.sort_array(numbered)).otherwise(F.array().cast("array<struct<h:string,p:int>>")).alias("marked"))
    df = df.select(*kept, _twice("marked").alias("at"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "stop_words",
        _covered("at", window).alias("n_repeat_words"),
        F.try_divide("word_chars", "n_words").alias("mean_word"),
        F.try_divide("n_symbols", "n_words").alias("symbols_per_word"),
        F.try_divide("n_dup_lines", "n_lines").alias("duplicate_lines"),
        F.try_divide("n_marked", "n_lines").alias("marked_lines"),
    )


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"),
    )
