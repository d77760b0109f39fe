"""Operator 1: Bradley-Terry document quality.

Preference pairs (a label-1 document over a label-0 document) are drawn from a
bounded sample of labelled rows (``per_class`` rows a label, ``pairs`` pairs); the
strength ``s = w.x`` of a document is learned by logistic loss on feature differences.
The operating point is the ``quantile`` of the sample's strengths, its rows weighted to
the labels' own shares; by default that is the share of label 0 among all labelled rows
outside the held-out fold.  Strengths are mapped to 0..1 by a logistic curve that passes
0.3 exactly at that quantile, so a threshold of 0.3 is a threshold by quantile.

Defined cases: null text counts as empty; an empty text has all-zero features and
gets a score as any other; very long texts are measured whole, in linear time; a null id
has a null ``held_out`` and is scored, never learned from; repeated rows and equal
strengths get equal scores, one row each; an empty documents table gives an empty
result; without both labels every document scores 0.5.  Only ``doc_id`` and ``text``
are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import add_columns, held_out, labelled_sample

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that it for on as with was be by this are or an at from not have but "
    "der die und in zu den das nicht von sie ist des sich mit dem er es ein auf so eine auch als an "
    "de la le et les des en un du une que est pour qui dans au par pas plus sur se ne ce avec "
    "el los del las por con para su al lo como pero sus o este si porque esta entre cuando".split()
)
FEATURES = (
    "log_words", "mean_word", "long_words", "distinct_words", "repeated_triples", "stop_share",
    "dup_lines", "words_per_line", "upper", "digits", "symbols", "exclaims", "pipes", "stops", "commas",
    "non_ascii", "symbol_words", "one_letter_words", "top_word", "url_marks",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~=_", np.uint8)


def features(text: str | None) -> list[float]:
    """Dense, language-neutral measures of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = set(zip(words, words[1:], words[2:])) if n > 3 else ()
    solid = max(1, size - int(hist[32] + hist[10] + hist[9] + hist[13]))
    lengths = [len(w) for w in counts]
    return [
        float(np.log1p(n)),
        sum(len(w) * c for w, c in counts.items()) / n,
        sum(x > 14 for x in lengths) / len(counts),
        len(counts) / n,
        1 - len(triples) / (n - 2) if n > 3 else 0.0,
        sum(c for w, c in counts.items() if w in STOP_WORDS) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(hist[65:91].sum()) / solid,
        float(hist[48:58].sum()) / solid,
        float(hist[_SYMBOLS].sum()) / solid,
        float(hist[33] + hist[63]) / n,
        float(hist[124]) / n,
        float(hist[46]) / n,
        float(hist[44]) / n,
        float(hist[128:].sum()) / solid,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n,
        sum(c for w, c in counts.items() if len(w) == 1) / n,
        max(counts.values()) / n if n > 20 else 0.0,
        text.count("://") / n,
    ]


def _frame(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _expand(x: np.ndarray) -> np.ndarray:
    """Plain values and square roots: strength may bend in each measure."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


class BradleyTerry:
    """Standardiser, weights, and the logistic map of strength to score."""

    def __init__(self, mean, scale, weights, slope, cut, quantile):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.slope, self.cut, self.quantile = slope, cut, quantile

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_expand(x) - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = self.slope * (self.strength(x) - self.cut) + np.log(0.3 / 0.7)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, share_low: float, pairs: int = 40_000, ridge: float = 3.0, quantile: float | None = None) -> BradleyTerry:
    """Newton steps on the pairwise logistic loss over ``pairs`` drawn pairs.

    ``share_low`` is the label-0 share of all labelled rows, and the quantile of strength
    that becomes the operating point unless another ``quantile`` is given.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(0, 1, None, 1, 0, 0)
    e = _expand(x)
    mean, scale = e.mean(0), e.std(0) + 1e-6
    z = np.clip((e - mean) / scale, -6, 6)
    rng = np.random.default_rng(7)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    weight = np.where(y == 1, (1 - share_low) / len(good), share_low / len(bad))
    quantile = share_low if quantile is None else quantile
    order = np.argsort(s, kind="stable")
    # The last strength below the quantile and the next one; the cut lies between them.
    below = np.cumsum(weight[order])
    k = int(np.clip(np.searchsorted(below, quantile - 1e-12), 0, len(s) - 1))
    cut = (s[order][k] + s[order][min(k + 1, len(s) - 1)]) / 2
    # Slope of a weighted logistic calibration through the cut.
    t = np.clip(s - cut, -50, 50)
    slope = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * t + np.log(0.3 / 0.7), -50, 50)))
        g, h = (weight * (y - p) * t).sum() - 1e-3 * slope, (weight * p * (1 - p) * t * t).sum() + 1e-3
        slope = float(np.clip(slope + g / h, 0.05, 20))
    return BradleyTerry(mean, scale, w, slope, cut, quantile)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000) -> BradleyTerry:
    """Fit on at most ``2 * per_class`` labelled rows outside the held-out fold."""
    sample = labelled_sample(labels, label, 5, 0, per_class)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(_frame(b["text"]))})

    got = rows.mapInPandas(measure, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values(["doc_id", "y"], kind="stable")
    shares = {r["y"]: r["n"] for r in labels.where(~held_out("doc_id", 5, 0)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    low = shares.get(0, 0) / max(1, shares.get(0, 0) + shares.get(1, 0))
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.int64), low)


def rank_quality(documents: DataFrame, model: BradleyTerry, cut: float = 0.3) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, quality_strength."""

    def start():
        def score(texts: list) -> dict:
            x = _frame(texts)
            s = model.score(x)
            strength = model.strength(x) if model.weights is not None else np.zeros(len(x))
            return {"score": s, "predicted": (s >= cut).astype("int32"), "quality_strength": strength}

        return score

    rows = documents.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return add_columns(rows, "score double, predicted int, quality_strength double", start)
