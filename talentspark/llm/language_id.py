"""Operator 3: language identification by multinomial naive Bayes.

Character n-grams (orders 1 to 3 over letters, other characters read as one blank)
are hashed into ``buckets`` columns.  The class-by-bucket log-probability matrix has
a fixed size, is broadcast, and whole texts are scored in numpy batches: the rows of
the occurring buckets are gathered and summed per document.

Learning is bounded by parameters: about ``per_language`` whole documents a language, and
the ``most_languages`` values of ``lang`` with the most documents, so that stray tags do
not widen the matrix.

Defined cases: null text or a text without any letter gives ``und`` with score 0; rows
with a null ``lang`` or id are scored but never learned from (``held_out`` of a null id is
null); very long texts are counted whole, block by block, each n-gram once; repeated rows
are scored one by one; with nothing to learn from every row is ``und``; ties go to the
language first in name order; an empty table gives an empty result.  ``identify`` reads
only ``doc_id`` and ``text``; ``keep_known`` passes all columns on as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import add_columns, held_out, keep_rows, worker_cache

ORDERS = (1, 2, 3)
_CHUNK = 400_000


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points between two blanks, non-letters as 0."""
    letter = worker_cache("letters", _letters)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.concatenate([[0], np.where(letter[c], c, 0), [0]]).astype(np.uint32)


def _grams(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of each n-gram; grams without a letter go to the spare bucket ``buckets``."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    some = np.zeros(n, bool)
    for k in range(order):
        c = codes[k : k + n]
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        some |= c > 0
    return np.where(some, (h % np.uint32(buckets)).astype(np.int64), buckets)


def _gram_blocks(codes: np.ndarray, order: int, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of one text, each n-gram once, in blocks of bounded size."""
    for at in range(0, len(codes) - order + 1, _CHUNK):
        yield _grams(codes[at : at + _CHUNK + order - 1], order, buckets)


@dataclass
class NaiveBayes:
    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray  # (buckets + 1, languages); the spare row is zero

    @property
    def buckets(self) -> int:
        return len(self.log_prob) - 1


def train(
    documents: DataFrame, per_language: int = 1500, buckets: int = 1 << 15, alpha: float = 0.5, most_languages: int = 200
) -> NaiveBayes:
    """Learn from about ``per_language`` whole documents a language (by a hash of the id), outside the held-out fold.

    Counts are summed by Spark; the driver gets at most ``buckets`` x ``most_languages`` numbers.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["n"] for r in common.collect()}
    languages = sorted(sizes)
    if not languages:
        return NaiveBayes([], np.zeros(0), np.zeros((buckets + 1, 0), np.float32))
    # The hash of an id lies under this bound for the wanted share of a language's documents, whatever their number.
    bound = {k: min(2**63 - 1, int(min(1.0, per_language / n) * 2**64) - 2**63) for k, n in sizes.items()}
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(bound[k]).cast("long"))])
    sample = known.where(F.xxhash64("doc_id") <= F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                into = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                codes = _codes(text)
                for order in ORDERS:
                    for block in _gram_blocks(codes, order, buckets):
                        into += np.bincount(block, minlength=buckets + 1)
        for lang, into in total.items():
            at = np.flatnonzero(into[:buckets])
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": into[at]})

    counts = (
        sample.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    m = np.zeros((buckets, len(languages)))
    m[counts["bucket"].to_numpy(dtype=np.int64), np.searchsorted(languages, counts["lang"].to_numpy(dtype=str))] = counts["n"]
    m = np.log((m + alpha) / (m.sum(0) + alpha * buckets))
    n = np.array([sizes[x] for x in languages], dtype=float)
    return NaiveBayes(languages, np.log(n / n.sum()), np.vstack([m, np.zeros((1, len(languages)))]).astype(np.float32))


def posteriors(model: NaiveBayes, texts: list[str]) -> np.ndarray:
    """Log-likelihood sums (one row a text) by gathering the rows of occurring buckets."""
    out = np.zeros((len(texts), len(model.languages)))
    batch: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if batch:
            codes = np.concatenate(batch)
            starts = np.cumsum([0] + [len(x) for x in batch[:-1]])
            for order in ORDERS:
                # Grams that straddle two texts have the closing and opening blank inside; their
                # rows are dropped by giving them to the spare bucket.
                g = _grams(codes, order, model.buckets)
                if not len(g):  # nothing but empty texts
                    continue
                for k in range(1, order):
                    edge = starts[1:] - k
                    g[edge[edge < len(g)]] = model.buckets
                np.add.at(out, owner, np.add.reduceat(model.log_prob[g], np.minimum(starts, len(g) - 1), axis=0))
        batch.clear(), owner.clear()
        size = 0

    for i, text in enumerate(texts):
        codes = _codes(text)
        if len(codes) > _CHUNK:
            for order in ORDERS:
                for block in _gram_blocks(codes, order, model.buckets):
                    out[i] += np.bincount(block, minlength=model.buckets + 1) @ model.log_prob.astype(float)
            continue
        batch.append(codes)
        owner.append(i)
        size += len(codes)
        if size > _CHUNK:
            flush()
    flush()
    return out / len(ORDERS)


def predict(model: NaiveBayes, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    clean = [t or "" for t in texts]
    lettered = np.array([t.isascii() and t.isalpha() or any(map(str.isalpha, t)) for t in clean], dtype=bool)
    if not model.languages or not len(clean):
        return ["und"] * len(clean), np.zeros(len(clean))
    z = posteriors(model, clean) + model.prior
    best = z.argmax(1)
    p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
    return [model.languages[k] if ok else "und" for k, ok in zip(best, lettered)], np.where(lettered, p, 0.0)


def identify(documents: DataFrame, model: NaiveBayes) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.log_prob))

    def start():
        known = NaiveBayes(*shared.value)

        def score(texts: list) -> dict:
            lang, p = predict(known, texts)
            return {"lang_pred": lang, "score": p}

        return score

    rows = documents.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return add_columns(rows, "lang_pred string, score double", start)


def keep_known(documents: DataFrame, model: NaiveBayes, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language at a posterior of ``least`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.log_prob))

    def start():
        known = NaiveBayes(*shared.value)

        def keep(texts: list) -> list:
            lang, p = predict(known, texts)
            return [x != "und" and s >= least for x, s in zip(lang, p)]

        return keep

    return keep_rows(documents, start)
