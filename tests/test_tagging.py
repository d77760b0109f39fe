"""Subword cuts, windows, and tags joined to spans."""

import numpy as np

from talentspark.operators import tagging

PIECES = {"[UNK]": 0, "play": 1, "##ing": 2, "##ers": 3, "##er": 4, "##s": 5, "p": 6, "##lay": 7, ",": 8, "new": 9, "york": 10, "##i": 11}
KNOWN = tagging.Vocabulary(PIECES, 0)


def test_wordpieces(spark):
    """The longest piece first, unknown words whole, signs and CJK alone, offsets in the text as given."""
    docs = spark.createDataFrame([(1, "Playing, PLAYERS xyz"), (2, None), (3, ""), (4, "play一p İ new"), (5, "  \n")], "id long, text string")
    got = {}
    for r in tagging.wordpieces(docs, "id", KNOWN).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["piece"], r["start"], r["stop"]))
    assert got == {
        1: [(1, 0, 4), (2, 4, 7), (8, 7, 8), (1, 9, 13), (3, 13, 16), (0, 17, 20)],
        4: [(1, 0, 4), (0, 4, 5), (6, 5, 6), (0, 7, 8), (9, 9, 12)],
    }


def test_window_starts():
    assert tagging.window_starts(0, 4, 2) == [] and tagging.window_starts(4, 4, 2) == [0]
    for n in range(1, 40):
        for size, overlap in ((4, 2), (5, 0), (6, 5)):
            covered = {i for a in tagging.window_starts(n, size, overlap) for i in range(a, a + size)}
            assert set(range(n)) <= covered and all(a >= 0 for a in tagging.window_starts(n, size, overlap))


def test_windows_do_not_change_context_of_reach():
    """A tagger that looks ``reach`` tokens to each side tags alike in windows and over the whole text where the overlap is twice that."""
    rng, reach = np.random.default_rng(7), 3

    def tagger(windows):
        out = []
        for ids in windows:
            padded = np.pad(ids, reach)
            near = sum(padded[k : k + len(ids)] for k in range(2 * reach + 1))
            out.append((near % 3, near / 100))
        return out

    for n in (1, 5, 20, 21, 57, 200):
        ids = rng.integers(1, 9, n)
        whole = tagger([ids])[0]
        tags, sure = tagging._tagged(ids, tagger, 20, 2 * reach + 1, 2)
        assert (tags == whole[0]).all() and np.allclose(sure, whole[1])


def test_joined_tags(spark):
    """B begins, I goes on, I of another kind or after a gap begins, weak spans go."""
    rows = [
        (1, 0, 0, 3, "B-LOC", 0.9), (1, 1, 4, 8, "I-loc", 0.7), (1, 2, 9, 12, "B-LOC", 0.8), (1, 3, 13, 15, "I-PER", 0.6), (1, 5, 20, 22, "I-PER", 0.6), (1, 6, 22, 25, "I-PER", 0.2), (2, 0, 0, 1, "I-ORG", 1.0),
    ]
    tokens = spark.createDataFrame(rows, "id int, pos int, start int, stop int, label string, confidence double")
    got = sorted((r["id"], r["start"], r["stop"], r["kind"], r["tokens"], round(r["confidence"], 6)) for r in tagging.joined_tags(tokens, "id").collect())
    assert got == [(1, 0, 8, "LOC", 2, 0.8), (1, 9, 12, "LOC", 1, 0.8), (1, 13, 15, "PER", 1, 0.6), (2, 0, 1, "ORG", 1, 1.0)]
    assert tagging.joined_tags(tokens.limit(0), "id").count() == 0


def test_tagged_texts(spark):
    """Places found across windows of four tokens; a repeated run gives the same spans."""
    labels = ["O", "B-LOC", "I-LOC"]

    def tagger(windows):
        tag = {9: 1, 10: 2}
        return [(np.array([tag.get(i, 0) for i in ids.tolist()]), np.full(len(ids), 0.75)) for ids in windows]

    text = "play " * 5 + "New York, " + "play " * 4 + "new york"
    docs = spark.createDataFrame([(1, text), (2, "York"), (3, None)], "id long, text string")
    spans = tagging.joined_tags(tagging.tagged_tokens(docs, "id", KNOWN, tagger, labels, 4, 2, 2), "id")
    got = sorted((r["id"], r["start"], r["value"], r["tokens"]) for r in tagging.with_values(spans, docs, "id").collect())
    assert got == [(1, 25, "New York", 2), (1, 55, "new york", 2), (2, 0, "York", 1)]
def test_tags_come_from_the_deepest_window():
    """Each token has its tag from the window in which it stands farthest from an edge that is not the text's, the first of equals."""
    for size, overlap in ((4, 2), (5, 0), (6, 5), (7, 3)):
        for n in range(1, 40):
            calls = []
            tagging._tagged(np.arange(n), lambda windows: calls.extend(windows) or [(w, w / 2) for w in windows], size, overlap, 3)
            number = iter(range(len(calls)))
            tags, _ = tagging._tagged(np.arange(n), lambda windows: [(np.full(len(w), next(number)), w / 2) for w in windows], size, overlap, 3)
            starts = tagging.window_starts(n, size, overlap)

            def depth(k, p):
                left, right = p - starts[k], starts[k] + len(calls[k]) - 1 - p
                return min(left if starts[k] else n, right if starts[k] + len(calls[k]) < n else n)

            for p in range(n):
                inside = [k for k, a in enumerate(starts) if a <= p < a + len(calls[k])]
                assert tags[p] == max(inside, key=lambda k: (depth(k, p), -k)), (size, overlap, n, p)


def test_spans_go_on_over_batches_by_one_sort(spark):
    """Spans do not end with a batch; tokens are sorted once, without windows over rows."""
    rows = [(i % 3, i // 3, i, i + 1, "B-X" if i // 3 % 5 == 0 else "I-x", 0.9) for i in range(90)] + [(None, i, i, i + 1, "I-Y", 0.8) for i in range(4)]
    tokens = spark.createDataFrame(rows, "id int, pos int, start int, stop int, label string, confidence double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        spans = tagging.joined_tags(tokens, "id")
        got = sorted((-1 if r["id"] is None else r["id"], r["start"], r["kind"], r["tokens"], round(r["confidence"], 6)) for r in spans.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(-1, 0, "Y", 4, 0.8)] + [(d, 15 * k + d, "X", 5, 0.9) for d in range(3) for k in range(6)]
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Sort") == 1
