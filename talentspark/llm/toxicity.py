"""Operator 10: toxicity by gradient-boosted trees over dense features.

A lexicon of whole words and word beginnings is learned from a bounded labelled
sample by log-odds (terms must occur in many different contexts, so that passages
repeated across documents teach nothing).  Densities of its hits, their distance to
second-person words, capitals, punctuation and obfuscation rates feed boosted
regression trees on the logistic loss; isotonic regression on a part of the sample
the trees did not see, weighted to the labels' true shares, turns margins into
probabilities.  Learning is bounded by parameters: ``per_class`` rows a label, ``size``
terms in the lexicon.

Defined cases: null text counts as empty; an empty text has all-zero features and is
scored as any other; very long texts and words are read whole, in linear time; without
both labels every document scores the share of label 1 (0 where there is none); a null
id has a null ``held_out`` and is scored, never learned from; repeated rows are scored one
by one and equal margins get equal scores; an empty table gives an empty result.
``score_toxicity`` reads only ``doc_id`` and ``text``; ``keep_clean`` passes all columns
on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import add_columns, held_out, keep_rows, labelled_sample, worker_cache

#: Second-person words of the four languages (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros".split()
)
#: Common English insults, a floor below the learned lexicon (fixed values).
SEED = frozenset("idiot idiots moron morons stupid pathetic loser losers disgusting scum worthless trash dumb".split())
FEATURES = (
    "lexicon_density", "prefix_density", "seed_density", "log_hits", "hits_near_you", "caps_words", "upper",
    "exclaims", "punctuation", "obfuscated", "unmasked_hits", "log_words", "second_person", "stretched",
)
PREFIXES = (4, 5)
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»„“”¿¡…"
_LEET = str.maketrans("013457@$!|", "oieastasil")
WORD, PREFIX, SEEDED, YOU, CAPS, MASKED, UNMASKED, STRETCHED = (1 << k for k in range(8))


def normal(word: str) -> str:
    """Lower-cased word without edge punctuation."""
    return word.lower().strip(_EDGE)


def unmasked(word: str) -> str:
    """The letters behind look-alike digits and signs, separators dropped."""
    return "".join(c for c in word.lower().strip(".,;:?\"'()").translate(_LEET) if c.isalpha())


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    prefixes: frozenset[str] = frozenset()

    def bits(self, word: str) -> int:
        w = normal(word)
        out = 0
        if not w:
            return out
        if w in self.words:
            out |= WORD
        if any(w[:k] in self.prefixes for k in PREFIXES if len(w) > k):
            out |= PREFIX
        if w in SEED:
            out |= SEEDED
        if w in SECOND_PERSON:
            out |= YOU
        if len(w) > 2 and word.isupper():
            out |= CAPS
        if not w.isalpha() and any(map(str.isalpha, w)) and not any(x in w for x in "@=:/"):
            out |= MASKED
            u = unmasked(word)
            if u != w and (u in self.words or u in SEED or any(u[:k] in self.prefixes for k in PREFIXES if len(u) > k)):
                out |= UNMASKED
        if any(a == b == c for a, b, c in zip(w, w[1:], w[2:])):
            out |= STRETCHED
        return out


def features(text: str | None, lexicon: Lexicon, seen: dict[str, int]) -> list[float]:
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = []
    for w in words:
        b = seen.get(w)
        if b is None:
            if len(seen) > 300_000:
                seen.clear()
            b = seen[w] = lexicon.bits(w)
        codes.append(b)
    c = np.array(codes, dtype=np.int64)
    n = len(c)
    hit = (c & (WORD | PREFIX | SEEDED | UNMASKED)) > 0
    you = np.flatnonzero(c & YOU)
    at = np.flatnonzero(hit)
    near = 0
    if len(you) and len(at):
        k = np.searchsorted(you, at)
        left = at - you[np.maximum(k - 1, 0)]
        right = you[np.minimum(k, len(you) - 1)] - at
        near = int((np.minimum(np.where(k > 0, left, 99), np.where(k < len(you), right, 99)) <= 5).sum())
    rate = lambda bit: float(((c & bit) > 0).sum()) / n
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(hist.sum()))
    return [
        rate(WORD), rate(PREFIX), rate(SEEDED), float(np.log1p(len(at))), near / n, rate(CAPS),
        float(hist[65:91].sum()) / size, float(hist[33]) / n, float(hist[33:48].sum() + hist[58:65].sum()) / n,
        rate(MASKED), rate(UNMASKED), float(np.log1p(n)), len(you) / n, rate(STRETCHED),
    ]


def learn_lexicon(rows: DataFrame, min_docs: int = 5, min_share: float = 0.013, min_log_odds: float = 3.0, size: int = 600) -> Lexicon:
    """Terms of the labelled rows (text, y) that mark label 1, counted by Spark; at most ``size`` come back.

    A term must be in ``min_share`` of the label-1 rows: among the very many rare words some are in
    label-1 rows alone by chance.
    """

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {"term": [], "y": [], "around": []}
            for text, y in zip(b["text"], b["y"]):
                words = [normal(w) for w in (text or "").split()]
                first: dict[str, int] = {}
                for i, w in enumerate(words):
                    if len(w) < 3 or w.isdigit():
                        continue
                    first.setdefault("=" + w, i)
                    for k in PREFIXES:
                        if len(w) > k:
                            first.setdefault("^" + w[:k], i)
                out["term"] += first
                out["y"] += [y] * len(first)
                out["around"] += [" ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2]) for i in first.values()]
            if out["term"]:
                yield pd.DataFrame(out)

    counted = (
        rows.mapInPandas(terms, "term string, y int, around string")
        .groupBy("term")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"), F.approx_count_distinct(F.when(F.col("y") == 1, F.col("around"))).alias("contexts"))
    )
    n = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in n}
    least = max(min_docs, min_share * n.get(1, 0))
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    best = counted.where((F.col("toxic") >= least) & (F.col("contexts") >= 0.6 * F.col("toxic")) & (odds >= min_log_odds))
    got = [r["term"] for r in best.orderBy(F.desc("toxic"), "term").limit(size).collect()]
    return Lexicon(frozenset(t[1:] for t in got if t[0] == "="), frozenset(t[1:] for t in got if t[0] == "^"))


@dataclass
class BoostedTrees:
    """Depth-limited trees over binned features, stored as flat arrays."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    depth: int = 3
    rate: float = 0.2

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += self.rate * value[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 48) -> BoostedTrees:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = BoostedTrees(base=float(np.log(p / (1 - p))), depth=depth, rate=rate)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for f in range(x.shape[1]):
                at = (node - first) * width + binned[:, f]
                gs = np.bincount(at, g, count * width).reshape(count, width)
                hs = np.bincount(at, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[:, len(cuts[f]) :] = 0
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                k = gain.argmax(1)
                for j in np.flatnonzero(gain[np.arange(count), k] > best + 1e-9):
                    best[j] = gain[j, k[j]]
                    feature[first + j], cut[first + j] = f, cuts[f][k[j]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((feature, cut, value))
        margin += rate * value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are block means of the margin, values are shrunk a little from 0 and 1."""
    order = np.lexsort((y, margin))
    blocks: list[list[float]] = []  # value * weight, weight, margin * weight
    for m, t, w in zip(margin[order], y[order], weight[order]):
        blocks.append([t * w, w, m * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    b = np.array(blocks)
    small = 0.5 * weight.mean()
    return b[:, 2] / b[:, 1], (b[:, 0] + small * 0.5) / (b[:, 1] + small)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), float(self.values[0]))
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)

    def score_texts(self, texts) -> np.ndarray:
        return self.score(_frame(texts, self.lexicon))


def _frame(texts, lexicon: Lexicon) -> np.ndarray:
    seen = worker_cache(("toxicity", lexicon.words, lexicon.prefixes), dict)
    return np.array([features(t, lexicon, seen) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def fit(x: np.ndarray, y: np.ndarray, share: float, lexicon: Lexicon) -> ToxicityModel:
    """Trees on three of four rows, isotonic calibration on the fourth, weighted to the true share of label 1."""
    if not (y == 1).any() or not (y == 0).any():
        return ToxicityModel(lexicon, None, np.zeros(1), np.array([share]))
    aside = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    trees = boost(x[~aside], y[~aside])
    on = aside if aside.any() else ~aside
    # The sample holds each class at most per_class times; weights give the classes their true shares back.
    weight = np.where(y[on] == 1, share / (y[on] == 1).sum(), (1 - share) / (y[on] == 0).sum()) * on.sum()
    return ToxicityModel(lexicon, trees, *isotonic(trees.margin(x[on]), y[on].astype(float), weight))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500) -> ToxicityModel:
    """Fit on at most ``2 * per_class`` labelled rows outside the held-out fold (crc32(id) mod 5 = 0)."""
    sample = labelled_sample(labels, label, 5, 0, per_class)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(12, "doc_id").cache()
    lexicon = learn_lexicon(rows.select("text", "y"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(_frame(b["text"], lexicon))})

    got = rows.mapInPandas(measure, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    rows.unpersist()
    counts = {r["y"]: r["n"] for r in labels.where(~held_out("doc_id", 5, 0)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.int64), share, lexicon)


def score_toxicity(documents: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""

    def start():
        def score(texts: list) -> dict:
            s = model.score_texts(texts)
            return {"score": s, "predicted": (s >= cut).astype("int32")}

        return score

    rows = documents.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return add_columns(rows, "score double, predicted int", start)


def keep_clean(documents: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score under ``cut``."""
    return keep_rows(documents, lambda: lambda texts: model.score_texts(texts) < cut)
