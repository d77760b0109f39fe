"""A stand-in for embedding models: hashed bags of tokens, deterministic on any engine.

A model plugs in as a function from a text column to an array column; ``hashed`` is the
one that needs no model.  ``embed_distinct`` computes each different text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .text import words
from .vectors import normalise


def hashed(text: Column, dim: int = 16) -> Column:
    """Unit vector of token counts by the MD5 of each token; all zero for a text without words."""
    slot = F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slot, lambda x: x == i)).cast("double"))
    return F.when(F.exists(counts, lambda x: x > 0), normalise(counts)).otherwise(counts)


def embed_distinct(rows: DataFrame, text: str, model: Callable[[Column], Column] = hashed) -> DataFrame:
    """rows with a column ``embedding``; each different text goes through the model once."""
    unique = rows.select(text).distinct().withColumn("embedding", model(F.col(text)))
    return rows.join(unique, text, "left")


def index_rows(skills: DataFrame, bullets: DataFrame, titles: DataFrame, least: int = 20) -> DataFrame:
    """(kind, source_id, text) of what a vector index holds: skills, bullets of ``least`` characters or more, titles."""
    take = lambda df, kind: df.select(F.lit(kind).alias("kind"), "source_id", "text").where(F.trim("text") != "")
    return take(skills, "skill").unionByName(take(bullets, "bullet").where(F.length(F.trim("text")) >= least)).unionByName(take(titles, "title"))


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of vectors of one length."""
    n = F.size(vectors)
    zero = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def entity_detector(rules: list[tuple[str, str, float]]):
    """A table function over texts: (value, kind, start, end, confidence) of each match of rules (kind, pattern, confidence).

    Rules are tried in order of priority; a later match that touches an earlier one is left out.
    """
    import re

    compiled = [(kind, re.compile(pattern), confidence) for kind, pattern, confidence in rules]

    @udtf(returnType="value string, kind string, start int, end int, confidence double")
    class Detect:
        def eval(self, text: str) -> Iterator[tuple]:
            taken: list[tuple[int, int]] = []
            for kind, pattern, confidence in compiled:
                for m in pattern.finditer(text or ""):
                    if all(m.end() <= a or b <= m.start() for a, b in taken):
                        taken.append(m.span())
                        yield m[0], kind, m.start(), m.end(), confidence

    return Detect


def score_in_chunks(docs: DataFrame, id_col: str, score: Callable[[Column], Column], size: int = 2000) -> DataFrame:
    """(id, score): the mean of a text scorer over whole-text chunks of ``size`` characters, for scorers with a length limit."""
    text = F.coalesce("text", F.lit(""))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return docs.select(id_col, F.explode(parts).alias("chunk")).groupBy(id_col).agg(F.avg(score(F.col("chunk"))).alias("score"))
