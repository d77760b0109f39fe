"""Phrase scan against a plain search by positions."""

import random

import pytest

from talentspark.operators import phrases


def plain(text, terms):
    low, out = text.lower(), {}
    word = lambda c: c.isalpha() or c.isdecimal()
    for t in {t.lower() for t in terms if t}:
        at = low.find(t)
        while at >= 0:
            before, after = low[at - 1 : at] if at else "", low[at + len(t) : at + len(t) + 1]
            if not (before and word(before)) and not (after and word(after)) and (len(t) > 2 or before in ("", " ", ",", "\n")):
                out[t] = out.get(t, 0) + 1
            at = low.find(t, at + 1)
    return out


def scanned(spark, texts, terms, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = phrases.phrase_scan(df, "doc_id", spark.createDataFrame([(t,) for t in terms], "term string"), **more).collect()
    return {(r["doc_id"], r["term"]): r["n"] for r in rows}


TERMS = ["node.js", "ASP.NET", "ci/cd", "scikit-learn", "C++", "google cloud platform", "google cloud", "objective-c", "R", "c", "C#", ".net", "go", "a a", "", "é", "machine learning"]
TEXTS = [
    "Node.js ASP.NET ci/cd scikit-learn c++ Google Cloud Platform; google cloud objective-C and R", "C, c++,c\nC# (c) cc c", None, "", "a a a a b", "Used .NET core; let's go. Go! ergo gopher 9go go9", "é é,é Éé", "x" * 50_000 + " machine learning",
]


@pytest.mark.parametrize("most", [8_000_000, 12])
def test_phrases(spark, most):
    got = scanned(spark, TEXTS, TERMS, most_characters=most)
    assert got == {(i, t): n for i, x in enumerate(TEXTS) if x for t, n in plain(x, TERMS).items()}
    # All terms a text has at once are found, ".net" inside a word is not; a plus sign bounds "c".
    assert {t for i, t in got if i == 0} == {"node.js", "asp.net", "ci/cd", "scikit-learn", "c++", "c", "google cloud platform", "google cloud", "objective-c", "r"}


def test_large_dictionary(spark):
    """A hundred thousand terms more do not change what ten terms find."""
    rng = random.Random(5)
    more = ["".join(rng.choice("abcdefghij .#+-") for _ in range(rng.randint(4, 24))) + str(i) for i in range(100_000)]
    few = scanned(spark, TEXTS, TERMS)
    many = scanned(spark, TEXTS, TERMS + more, most_characters=700_000)
    assert {k: n for k, n in many.items() if k[1] in {t.lower() for t in TERMS}} == few
    assert scanned(spark, TEXTS, []) == {} and scanned(spark, [], TERMS) == {}


def test_random_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab c,.\nC+") for _ in range(300)) for _ in range(40)]
    terms = ["a", "ab", "a b", "c", "c+", "b.", ".a", "a,b", "ab c", "++", " a"]
    assert scanned(spark, texts, terms) == {(i, t): n for i, x in enumerate(texts) for t, n in plain(x, terms).items()}


def test_not_overlapping(spark):
    """Repeated lines: a phrase that ends as it begins is counted as a split from the left counts it, whether or not what is cut stands alone."""
    texts, terms = ["of the\nof the\nof the\nof the", "these these the end", "the the the the"], ["the\nof the", "these the", "the the"]
    want = {(i, t): len([a for a, b in zip(x.split(t), x.split(t)[1:]) if a[-1:] in ("", " ", "\n") and b[:1] in ("", " ", "\n")]) for i, x in enumerate(texts) for t in terms}
    assert scanned(spark, texts, terms, overlapping=False) == {k: n for k, n in want.items() if n} == {(0, "the\nof the"): 2, (2, "the the"): 2}
    assert scanned(spark, texts, terms)[(0, "the\nof the")] == 3
