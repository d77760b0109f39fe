"""The learned parts of operators 1, 7 and 10 against plain versions: loss by pairs, enumeration, finite differences, all splits."""

import itertools

import numpy as np

from talentspark.llm import pii_crf, quality_ranking, toxicity


def test_pairwise_loss_is_at_its_minimum():
    """At the fitted weights the gradient of the pairwise logistic loss, summed pair by pair, is null, and the gradient is that of the loss."""
    rng = np.random.default_rng(1)
    x = rng.gamma(2, 1, (60, len(quality_ranking.FEATURES)))
    y = (x[:, 0] + rng.normal(0, 1, 60) > 2).astype(int)
    model = quality_ranking.fit(x, y, 0.5, pairs=400, ridge=3.0)
    z = np.clip((np.hstack([x, np.sqrt(x)]) - model.mean) / model.scale, -6, 6)
    draw = np.random.default_rng(7)
    good, bad = draw.choice(np.flatnonzero(y == 1), 400), draw.choice(np.flatnonzero(y == 0), 400)

    def loss(w):
        return sum(np.log1p(np.exp(-(z[a] @ w - z[b] @ w))) for a, b in zip(good, bad)) + 1.5 * (w @ w)

    def gradient(w):
        g = 3.0 * w
        for a, b in zip(good, bad):
            d = z[a] - z[b]
            g = g - d / (1 + np.exp(d @ w))
        return g

    w = model.weights
    assert np.abs(gradient(w)).max() < 1e-6
    other = w + rng.normal(0, 0.1, len(w))
    numeric = [(loss(other + e) - loss(other - e)) / 2e-5 for e in 1e-5 * np.eye(len(w))]
    assert np.allclose(gradient(other), numeric, atol=1e-4) and loss(w) < loss(other)


def test_quality_features_by_hand():
    """Plain counts of a small text against the features."""
    text = "The cat sat.\nThe cat sat.\n\nA cat # 12, x!"
    f = dict(zip(quality_ranking.FEATURES, quality_ranking.features(text)))
    words = text.split()
    assert np.isclose(f["mean_word"], np.mean([len(w) for w in words])) and np.isclose(f["log_words"], np.log1p(len(words)))
    assert all(v == 0 for v in quality_ranking.features("")) and quality_ranking.features(None) == quality_ranking.features("")


def random_field(rng, scale):
    field = pii_crf.Field()
    for name in ("own", "before", "after", "moves", "start"):
        w = getattr(field, name)
        w[...] = rng.normal(0, scale, w.shape)
    field.own[:, 0] += 0.15
    return field


def line_score(field, tokens, labels):
    """Score of a labelling, feature by feature."""
    shapes = [field.edge, *[pii_crf.token_class(t) for t in tokens], field.edge]
    s = field.start[labels[0]]
    for t, y in enumerate(labels):
        s += sum(field.own[k, y] for k in field.columns(shapes[t + 1])) + sum(field.before[k, y] for k in field.columns(shapes[t])) + sum(field.after[k, y] for k in field.columns(shapes[t + 2]))
        s += field.moves[labels[t - 1], y] if t else 0
    return s


TOKENS = ["Ann", "mail", "a@b.com", "+49", "(0)30", "555-1234", "10.0.0.1", "4111", "now", "x=1", "12/5", "or", "[at]"]


def test_viterbi_by_enumeration():
    """The best of all labellings of short lines, through stretches that leave certain tokens out."""
    rng = np.random.default_rng(5)
    labels = range(1 + len(pii_crf.KINDS))
    some_outside = 0
    for scale in (0.05, 0.3, 0.6):
        decoder = pii_crf.Decoder(random_field(rng, scale))
        for _ in range(12):
            tokens = [TOKENS[i] for i in rng.integers(0, len(TOKENS), rng.integers(1, 5))]
            c = decoder.classes(tokens)
            stretches = decoder.stretches(c)
            got = np.zeros(len(tokens), int)
            for (a, b), found in zip(stretches, decoder.viterbi(c, stretches) if stretches else []):
                got[a:b] = found
            some_outside += len(tokens) - sum(b - a for a, b in stretches)
            best = max(line_score(decoder.field, tokens, y) for y in itertools.product(labels, repeat=len(tokens)))
            assert np.isclose(line_score(decoder.field, tokens, got), best)
    assert some_outside > 0


def test_field_gradient_by_finite_differences(monkeypatch):
    """The gradients behind two training steps, read back from the weights, against differences of the likelihood by enumeration."""
    monkeypatch.setattr(pii_crf, "LABELLED", "mail <email a@b.com> now\n<phone +49 555-1234>\nat <ip 10.0.0.1> x=1")
    rows, train, rate = pii_crf._labelled(), pii_crf.train.__wrapped__, 0.4
    one, two = train(1, rate), train(2, rate)
    names, decay = ("own", "before", "after", "moves", "start"), {"moves": 0.2, "start": 0.2}
    labels = range(1 + len(pii_crf.KINDS))

    def likelihood(field):
        total = 0.0
        for tokens, truth in rows:
            every = [line_score(field, tokens, y) for y in itertools.product(labels, repeat=len(tokens))]
            total += line_score(field, tokens, truth) - np.logaddexp.reduce(every)
        return total - sum(decay.get(n, 5e-4) / 2 * (getattr(field, n) ** 2).sum() for n in names)

    rng = np.random.default_rng(2)
    for name in names:
        w, step = getattr(one, name), getattr(two, name) - getattr(one, name)
        first = w * 0.1 / np.sqrt(rate**2 - w**2)
        second = step * np.sqrt(1e-2 + first**2) / np.sqrt(rate**2 - step**2)
        cells = np.argwhere(np.abs(second) > 1e-3)
        assert len(cells)
        for cell in map(tuple, cells[rng.permutation(len(cells))[:4]]):
            kept = w[cell]
            w[cell] = kept + 1e-4
            up = likelihood(one)
            w[cell] = kept - 1e-4
            down = likelihood(one)
            w[cell] = kept
            assert np.isclose(second[cell], (up - down) / 2e-4, rtol=1e-3, atol=1e-5)


def test_trees_by_all_splits():
    """Every split is the best of all, every leaf the Newton value of its rows, tree after tree."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(0, 1, (120, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    depth, ridge, rate = 2, 1.0, 0.2
    model = toxicity.boost(x, y, rounds=4, depth=depth, rate=rate, ridge=ridge, bins=10)
    cuts = [sorted(set(np.quantile(x[:, f], np.arange(1, 10) / 10).tolist())) for f in range(4)]
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for feature, cut, value in model.trees:
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)  # noqa: E731, B023
        at = {0: np.arange(len(y))}
        for node in range(2**depth - 1):
            rows = at[node]

            def gain(f, c):
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]  # noqa: B023
                return part(left) + part(right) - part(rows) if len(left) and len(right) else 0.0  # noqa: B023

            best = max(gain(f, c) for f in range(4) for c in cuts[f])
            assert np.isclose(gain(feature[node], cut[node]), best, atol=1e-8)
            goes = x[rows, feature[node]] > cut[node]
            at[2 * node + 1], at[2 * node + 2] = rows[~goes], rows[goes]
        for leaf in range(2**depth):
            rows = at[2**depth - 1 + leaf]
            assert np.isclose(value[leaf], g[rows].sum() / (h[rows].sum() + ridge))
            margin[rows] += rate * value[leaf]
    assert np.allclose(model.margin(x), margin)
