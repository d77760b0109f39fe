"""Scan of texts for dictionary phrases of any length and any characters.

An automaton over all phrases reads a text once, whatever the number of phrases; a hit counts where no letter or digit
stands on either side, and phrases of one or two characters only behind a blank, a comma, a line end or nothing.
Phrases are held ``most_characters`` at a time; a larger dictionary takes one pass over the texts for each such part,
with the same result, so neither a worker nor the driver holds more than one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BEFORE_SHORT = (" ", ",", "\n")


def _word(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


def _automaton(phrases: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(p, p)
    found.make_automaton()
    return found


def hits_in(text: str, automaton, overlapping: bool = True) -> dict[str, int]:
    """Positions at which each phrase stands by itself; they may overlap, or are taken from the left, each behind the phrase's last."""
    out: dict[str, int] = {}
    behind: dict[str, int] = {}
    for end, p in automaton.iter(text):
        start = end - len(p) + 1
        if not overlapping:
            if start < behind.get(p, 0):
                continue
            behind[p] = end + 1
        if start > 0 and (_word(text[start - 1]) or (len(p) <= 2 and text[start - 1] not in _BEFORE_SHORT)):
            continue
        if end + 1 < len(text) and _word(text[end + 1]):
            continue
        out[p] = out.get(p, 0) + 1
    return out


def _parts(phrases: DataFrame, most_characters: int) -> Iterator[list[str]]:
    """Lower-cased distinct phrases, some at a time; a hash deals them out, so parts are near their bound."""
    known = phrases.select(F.lower(phrases.columns[0]).alias("p")).where("p <> ''").distinct()
    size = known.agg(F.sum(F.length("p"))).first()[0] or 0
    n = -(-size // most_characters)
    for i in range(n):
        part = [r["p"] for r in known.where(F.pmod(F.xxhash64("p"), F.lit(n)) == i).collect()]
        if part:
            yield part


def phrase_scan(texts: DataFrame, id_col: str, phrases: DataFrame, text_col: str = "text", most_characters: int = 8_000_000, overlapping: bool = True) -> DataFrame:
    """(id, term, n): how often each lower-cased phrase of the one column of ``phrases`` stands by itself in each text.

    Case is ignored.  Null texts have no hits; repeated ids are added up; a phrase's inner blanks and signs are taken as they are.
    Where ``overlapping`` is false, a text is cut at each phrase from the left, as ``string_split`` does, and pieces count once.
    """
    id_type = texts.schema[id_col].dataType.simpleString()
    # Both sides are lower-cased by Spark, so that one rule holds for signs whose lower case is longer.
    low = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    spark, found = texts.sparkSession, None
    for part in _parts(phrases, most_characters):
        held = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held.value)
            for b in batches:
                at, terms, counts = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    own = hits_in(t, automaton, overlapping)
                    at += [i] * len(own)
                    terms += own
                    counts += own.values()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["id", "term", "n"])

        hits = low.mapInArrow(scan, f"id {id_type}, term string, n long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = low.select("id", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).where("false")
    return found.groupBy(F.col("id").alias(id_col), "term").agg(F.sum("n").alias("n"))
