"""Page reading order, spells under similar names, components, windows over late rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from talentspark.functions import text as T
from talentspark.operators import dedup, graph, records
from talentspark.streaming import jobs

BOX = "doc int, page int, x double, y double, width double, size double, text string"


def page(spark, boxes):
    df = spark.createDataFrame([(1, p, float(x), float(y), float(w), float(s), t) for p, x, y, w, s, t in boxes], BOX)
    return [(r["page"], r["column"], r["text"], r["level"]) for r in records.reading_order(df).orderBy("page", "column", "line").collect()]


def test_two_columns(spark):
    """The left column is read before the right one; a page without steady gaps is read across; headings by size and by capitals."""
    two = [(1, 50 + 60 * k, 20 * r, 50, 10, f"l{r}{k}") for r in range(4) for k in range(2)] + [(1, 300 + 60 * k, 20 * r, 50, 10, f"r{r}{k}") for r in range(4) for k in range(2)]
    one = [(2, 50, 0, 90, 20, "Curriculum"), (2, 50, 20, 60, 13, "Work"), (2, 50, 40, 30, 10, "SKILLS"), *[(2, 50 + 60 * k, 60 + 20 * r, 55, 10, f"w{r}{k}") for r in range(3) for k in range(5)]]
    got = page(spark, two + one)
    assert [x[2] for x in got[:8]] == ["l00 l01", "l10 l11", "l20 l21", "l30 l31", "r00 r01", "r10 r11", "r20 r21", "r30 r31"]
    assert [x[1] for x in got] == [0] * 4 + [1] * 4 + [0] * 6
    assert [x[2:] for x in got[8:]] == [("Curriculum", 1), ("Work", 2), ("SKILLS", 2), *[(f"w{r}0 w{r}1 w{r}2 w{r}3 w{r}4", None) for r in range(3)]]
    assert records.reading_order(spark.createDataFrame([], BOX)).count() == 0


def test_few_words_are_one_column(spark):
    """Nine words with a wide gap in each row stay one column."""
    assert {x[1] for x in page(spark, [(1, 50 + 300 * k, 20 * r, 50, 10, "a") for r in range(4) for k in range(2)] + [(1, 50, 90, 50, 10, "a")])} == {0}


def test_components(spark):
    """Against a closure by hand: a chain of 200, a star, random links, self-links and repeats."""
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5000, 5000), (7, 6), (7, 6)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {a: find(a) for a in list(root)}
    assert graph.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def spells(spark, rows, grace=90):
    day = lambda x: dt.date.fromisoformat(x) if x else None
    df = spark.createDataFrame([(k, c, day(a), day(b)) for k, c, a, b in rows], "owner int, company string, start_date date, stop date")
    key = lambda t: tuple(map(str, t))
    return sorted([(r["owner"], r["company"], str(r["start_date"]), str(r["stop"]), r["names"], r["n"]) for r in dedup.merged_similar(df, "owner", "company", grace).collect()], key=key)


def test_similar_spells(spark):
    """Names alike and dates that touch are one spell, through a chain; others stay apart, as do other owners and rows without name or start."""
    rows = [
        (1, "Acme", "2018-01-01", "2019-01-01"), (1, "ACME Ltd.", "2019-03-01", "2020-01-01"), (1, "Acme Robotics GmbH", "2020-02-01", "2021-01-01"), (1, "Robotics", "2021-03-15", "2022-01-01"),
        (1, "Acme", "2023-01-01", "2023-06-01"), (1, "Acmeville", "2018-01-01", "2019-01-01"), (2, "Acme", "2018-01-01", "2018-02-01"), (1, None, "2018-01-01", "2019-01-01"), (1, "  ", "2018-01-01", "2019-01-01"), (1, "Acme", None, "2019-01-01"),
    ]
    assert spells(spark, rows) == sorted([
        (1, "Acme Robotics GmbH", "2018-01-01", "2022-01-01", 3, 4), (1, "Acme", "2023-01-01", "2023-06-01", 1, 1), (1, "Acmeville", "2018-01-01", "2019-01-01", 1, 1), (2, "Acme", "2018-01-01", "2018-02-01", 1, 1),
        (1, None, "2018-01-01", "2019-01-01", 1, 1), (1, "  ", "2018-01-01", "2019-01-01", 1, 1), (1, "Acme", "None", "2019-01-01", 1, 1),
    ], key=lambda t: tuple(map(str, t)))
    assert spells(spark, rows[:0]) == []


def test_spells_across_buckets(spark):
    """A spell of many years meets a short one inside it once, whatever time buckets they fall in."""
    assert spells(spark, [(1, "Bolt", "2000-01-01", "2020-01-01"), (1, "Bolt Works", "2010-05-05", "2010-06-06")]) == [(1, "Bolt Works", "2000-01-01", "2020-01-01", 2, 2)]


def test_late_rows(spark):
    """A row whose window has closed is dropped; a late row joins an open session but does not reopen a closed one."""
    at = lambda rows: spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) t")
    batches = [at([("a", "2024-01-01 00:10"), ("a", "2024-01-01 00:40"), ("b", "2024-01-01 06:00")]), at([("a", "2024-01-01 00:20"), ("b", "2024-01-01 05:30"), ("b", "2024-01-01 12:00")]), at([("z", "2024-01-03 00:00")])]
    show = lambda df: sorted((r["k"], r["a"], r["n"]) for r in df.select("k", F.date_format("window.start", "dd HH:mm").alias("a"), "n").collect())
    tumbling = jobs.closed_windows(batches, lambda s: jobs.windowed_counts(s, "t", "k", "1 hour", "2 hours"))
    assert show(tumbling) == [("a", "01 00:00", 2), ("b", "01 05:00", 1), ("b", "01 06:00", 1), ("b", "01 12:00", 1)]
    sessions = jobs.closed_windows(batches, lambda s: jobs.session_counts(s, "t", "k", "1 hour", "2 hours"))
    assert show(sessions) == [("a", "01 00:10", 2), ("b", "01 05:30", 2), ("b", "01 12:00", 1)]


def test_joined_initials(spark):
    """Capitals that stand apart join the word after them; others, and names that do not look so, give null."""
    want = {
        "F ELIPE M AGNO DE A LMEIDA": "Felipe Magno De Almeida", "J ANE D OE": "Jane Doe", "J A N E  D O E": None, "Jane A Doe B": "Jane Adoe B", "A NN": None, "x ANN y BOB": None, "Ann B C Dee": "Ann B Cdee", "É MILE  Z OLA": "Émile Zola", "": None,
    }
    df = spark.createDataFrame([*[(k,) for k in want], (None,)], "name string")
    assert {r["name"]: r["joined"] for r in df.select("name", T.join_initials(F.col("name")).alias("joined")).collect()} == want | {None: None}


def test_spells_meet_by_numbers(spark, monkeypatch):
    """Spells are linked by numbers, neither by their names nor by digests, and a short name in many longer ones links only within its key."""
    seen = []
    monkeypatch.setattr(dedup, "connected", lambda links, own=dedup.connected: seen.append(links) or own(links))
    rows = [(k, f"Acme {w} Works", dt.date(2000, 1, 1), dt.date(2000, 2, 1)) for k, w in enumerate("abcdefgh")] + [(3, "Acme", dt.date(2000, 1, 20), dt.date(2000, 3, 1))]
    df = spark.createDataFrame(rows, "owner long, company string, start_date date, stop date")
    got = {(r["owner"], r["company"], str(r["stop"]), r["names"], r["n"]) for r in dedup.merged_similar(df, "owner", "company").collect()}
    assert got == {(k, f"Acme {w} Works", "2000-03-01" if k == 3 else "2000-02-01", 2 if k == 3 else 1, 2 if k == 3 else 1) for k, w in enumerate("abcdefgh")}
    assert [t for _, t in seen[0].dtypes] == ["bigint", "bigint"] and seen[0].count() == 1
