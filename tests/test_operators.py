"""Operators on literal tables: documented semantics and edge cases."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentspark.functions import text as T
from talentspark.operators import dedup, filters, graph, ledger, matching, quality, tracking
from talentspark.operators.filters import Leaf, Node
from talentspark.plans import catalogue
from talentspark.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


JOB = "id int, skills array<string>, work_model string, salary double, text string, company string, is_remote boolean"


@pytest.mark.parametrize(
    "tree,expected",
    [
        (Leaf("skills", "In", [".NET"]), {1}), (Leaf("skills", "In", ["python"]), {2}), (Leaf("skills", "NotIn", ["Python"]), {1, 3}), (Leaf("salary", "GreaterThanOrEqual", 70000), {2}),
        (Leaf("salary", "Between", 50000, 100000), {2}), (Leaf("work_model", "Equal", "onsite"), {1}), (Leaf("is_remote", "IsFalse"), {1}), (Leaf("company", "Equal", "ACME"), {1}),
        (Leaf("company", "NotEqual", "acme"), {2, 3}), (Leaf("skills", "Contains", "net"), set()), (Node("All"), {1, 2, 3}), (Node("Any"), set()), (Leaf("salary", "GreaterThan", "no number"), {1, 2}),
        (Node("Not", [Node("All", [Leaf("company", "Equal", "acme"), Leaf("is_remote", "IsFalse")])]), {2, 3}), (Leaf("unknown", "Equal", 1), set()), (Leaf("unknown", "NotIn", [1]), {1, 2, 3}),
    ],
)
def test_filter(spark, tree, expected):
    jobs = spark.createDataFrame([(1, [".NET", "Azure"], "Onsite", 45000.0, "SaaS", "Acme", False), (2, ["Python"], "Remote", 75000.0, "fintech", "Other", True), (3, [], None, None, None, None, None)], JOB)
    fields = {c: F.col(c) for c in ("skills", "work_model", "salary", "company", "is_remote")}
    assert {r["id"] for r in jobs.where(filters.compile_filter(tree, fields, frozenset({"skills"}))).collect()} == expected


def test_filter_rejects():
    with pytest.raises(ValueError):
        filters.compile_filter(Node("Not", []), {})
    with pytest.raises(ValueError):
        filters.compile_filter(Leaf("a", "Like", 1), {})


EV = "entity int, experience int, seq int, skill string, category string, start_date date, end_date date, confidence double, source string"


def test_ledger(spark):
    d = dt.date
    rows = [(1, 1, 1, "sql", "db", d(2000, 1, 1), d(2001, 1, 1), 0.5, "R"), (1, 2, 1, "sql", "db", d(2000, 6, 1), d(2002, 1, 1), 0.9, "N"), (1, None, 1, "sql", "db", d(1990, 1, 1), d(1991, 1, 1), 0.9, "N"), (1, 3, 1, "c", "x", d(2001, 1, 1), None, 0.4, "N")]
    got = {r["skill"]: r for r in ledger.build_ledger(spark.createDataFrame(rows, EV), "2002-01-01").collect()}
    assert got["sql"]["role_count"] == 3 and got["sql"]["last_seen"] == d(2002, 1, 1) and not got["sql"]["is_current"]
    assert got["sql"]["years"] == pytest.approx((731 + 365) / 365.25)
    assert got["c"]["is_current"] and got["c"]["unsubstantiated"] and got["c"]["last_seen"] is None
    assert ledger.build_ledger(spark.createDataFrame([], EV), "2002-01-01").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30)), min_size=1, max_size=12))
def test_interval_union(spark, ranges):
    base = dt.date(2000, 1, 1)
    rows = [(1, i, 1, "s", "c", base + dt.timedelta(a), base + dt.timedelta(a + n), 0.5, "R") for i, (a, n) in enumerate(ranges)]
    days = ledger.interval_union(spark.createDataFrame(rows, EV), "2002-01-01").first()["days"]
    assert days == len({a + k for a, n in ranges for k in range(n)})


def test_vote_and_stage_folds(spark):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * day)
    v = spark.createDataFrame([("p", at(i), i, -1) for i in range(10)] + [("q", at(1), 1, 1), ("q", at(2), 2, -1)], "profile string, ts timestamp, seq int, delta int")
    assert {r["profile"]: r["score"] for r in tracking.vote_fold(v, ["profile"]).collect()} == {"p": -5, "q": 0}
    e = spark.createDataFrame([("a", at(i), i, x) for i, x in enumerate([0, 1, 5, 3, 2, 6, 8])], "application string, ts timestamp, seq int, to_stage int")
    r = tracking.stage_fold(e, ["application"]).first()
    assert (r["stage"], r["applied_at"], r["last_activity"], r["n_events"]) == (6, at(1), at(6), 7)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.sampled_from([-1, 1])), min_size=1, max_size=60))
def test_vote_fold_by_days(spark, votes):
    """Days folded to one clamped step each give what a running clamp over all votes gives."""
    votes = sorted(votes, key=lambda v: v[0])
    rows = [("p", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i, d) for i, (h, d) in enumerate(votes)]
    score = 0
    for _, d in votes:
        score = max(-2, min(2, score + d))
    assert tracking.vote_fold(spark.createDataFrame(rows, "profile string, ts timestamp, seq int, delta int"), ["profile"], -2, 2).first()["score"] == score


@pytest.mark.parametrize("text,start,end,current", [("Jan 2020 – Present", "2020-01-01", None, True), ("2020 - now", "2020-01-01", None, True), ("from Jan 2019 to Dec 2022", "2019-01-01", "2022-12-01", False), ("2019 – 2022", "2019-01-01", "2022-01-01", False), ("2020 to date", "2020-01-01", None, True), ("01/2019 - 05/2020", "2019-01-01", "2020-05-01", False), ("2019-01 to 2020-05", "2019-01-01", "2020-05-01", False), ("at 3.2012–now", "2012-03-01", None, True), ("call 0201999-2001", None, None, None), ("2019-2022", "2019-01-01", "2022-01-01", False), ("C# Python", None, None, None), ("", None, None, None)])
def test_date_range(spark, text, start, end, current):
    r = one(spark, T.date_range(F.lit(text)))
    assert (r is None) == (start is None)
    if r:
        assert text.lower()[r["match_start"] : r["match_end"] + 1].strip() == text.lower()[r["match_start"] :].strip()
        assert (str(r["start_date"]), str(r["end_date"]) if r["end_date"] else None, r["is_current"]) == (start, end, current)


def test_json_ld(spark):
    def page(*blocks):
        return "<html>" + "".join(f'<script id=x type="application/ld+json">{b}</script>' for b in blocks) + '<meta property="og:title" content="Shared"></html>'

    org, job = '{"@type": "Organization", "title": "Firm"}', '{"@type": "JobPosting", "title": "Dev", "baseSalary": {"currency": "USD", "value": 90}, "jobLocation": [{"address": {"addressLocality": "Bern"}}]}'
    for blocks in ([job], [org, job], [f"[{org}, {job}]"], [f'{{"@graph": [{org}, {job}]}}'], ["{not json", job], [job.replace('"JobPosting"', '["x:jobposting", "Thing"]')]):
        r = one(spark, T.json_ld_posting(F.lit(page(*blocks))))
        assert (r["title"], r["location"], r["salary_min"], r["salary_max"], r["salary_currency"]) == ("Dev", "Bern", 90.0, 90.0, "USD")
    for blocks in ([org], [], ["{"], ["[]"], ['{"@graph": []}'], [job.replace('"JobPosting"', '["Thing", "JobPosting"]')], ["3"]):
        assert one(spark, T.json_ld_posting(F.lit(page(*blocks))))["title"] == "Shared"


def test_text_functions(spark):
    assert one(spark, T.paren_split(F.lit("C# (.NET, Core), SQL , Go"))) == ["C# (.NET, Core)", "SQL", "Go"]
    assert one(spark, T.normalise_title(F.lit("Senior  Software Engineer"))) == "software engineer"
    assert one(spark, T.normalise_company(F.lit("Acme Widgets, Ltd."))) == "acme widgets"
    assert one(spark, T.title_similarity(F.lit("a b c"), F.lit("b c d e"))) == 0.5
    assert one(spark, T.salary_range(F.lit("£60,000 - £80,000"))[0]) == 60000 and one(spark, T.salary_range(F.lit("60k-80k"))[1]) == 80000
    assert one(spark, T.rewrite(F.lit("I was responsible for very big things"))) == "was led big things"
    assert one(spark, T.collapse_spaced(F.lit("K E Y   S K I L L S of a b team"))) == "KEY SKILLS of ab team"
    for kept in ("Grade A B student", "a b", "x y z and four more words here", "", "P a r t time work done"):
        assert one(spark, T.collapse_spaced(F.lit(kept))) == kept
    s = one(spark, T.salary(F.lit("RM 4,000 – RM 6,500 monthly")))
    assert (s["low"], s["high"], s["currency"], s["period"]) == (4000, 6500, "MYR", "monthly") and one(spark, T.salary(F.lit("none"))) is None
    assert one(spark, T.salary(F.lit("Salary: $55,000.25")))["high"] == 55000.25 and one(spark, T.claimed_years(F.lit("over 60 years of experience; min 3 years"))) == 3
    assert one(spark, T.education_level(F.lit("MSc, BSc"))) == "Masters" and one(spark, T.education_level(F.lit(None).cast("string"))) == "Unknown"
    assert one(spark, T.meets_education(F.lit("Masters"), "Bachelors")) and not one(spark, T.meets_education(F.lit("Unknown"), "Secondary")) and one(spark, T.meets_education(F.lit("Unknown"), ""))
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"},"jobLocation":[{"address":{"addressLocality":"Leeds"}}]}</script><p>x</p>'
    r = one(spark, T.json_ld_posting(F.lit(page)))
    assert (r["title"], r["company"], r["location"]) == ("Dev", "Acme", "Leeds")
    assert one(spark, T.json_ld_posting(F.lit('<meta property="og:title" content="Cook">')))["title"] == "Cook"


def test_mail_rules(spark):
    assert one(spark, tracking.classify_mail(F.lit("unfortunately after the interview")))["label"] == "Interview"
    assert one(spark, tracking.classify_mail(F.lit("hello"))) is None


def test_matching_and_dedup(spark):
    j = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "job_id int, skills array<string>")
    assert [round(r["score"], 3) for r in matching.simple_match(j, ["a"], ["b"], F.lit(2)).orderBy("job_id").collect()] == [0.5, 0.6]
    c = spark.createDataFrame([(1, "Acme.", "x", 0.9), (1, "acme", "y", 0.8), (1, "Other", "x", 0.95)], "doc int, value string, source string, confidence double")
    top = dedup.fuse(c, ["doc"]).where("rank = 1").first()
    assert top["norm"] == "acme" and top["confidence"] == pytest.approx(1.0)
    s = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["z"])], "id int, items array<string>")
    assert [tuple(r) for r in dedup.jaccard(s, 0.5).collect()] == [(1, 2, 2 / 3)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sets(st.integers(0, 7), min_size=0, max_size=5), min_size=1, max_size=14), st.sampled_from([0.4, 0.5, 0.8, 1.0]))
def test_jaccard(spark, sets, threshold):
    """Link counts and pairs of classes against all pairs."""
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id int, items array<int>")
    near = lambda a, b: a == b or (a | b and len(a & b) / len(a | b) >= threshold)
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in dedup.jaccard_links(frame, threshold).collect()}
    assert got == {i: (sets.index(x), sum(bool(near(x, y)) for y in sets) - 1) for i, x in enumerate(sets)}
    first = [i for i, x in enumerate(sets) if sets.index(x) == i]
    assert {(r["id"], r["id2"]) for r in dedup.jaccard(frame, threshold).collect()} == {(i, j) for i in first for j in first if i < j and near(sets[i], sets[j])}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sets(st.integers(0, 5), min_size=0, max_size=4), min_size=1, max_size=20), st.sampled_from([0.4, 0.5, 1.0]), st.sampled_from([1, 3, 1000]))
def test_jaccard_pairs(spark, sets, threshold, block):
    """Every pair of rows that reaches the threshold, equal sets in large classes among them, once."""
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id int, items array<int>")
    want = sorted((i, j, round(len(x & y) / len(x | y), 6)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x & y and len(x & y) / len(x | y) >= threshold)
    assert sorted((r["id"], r["id2"], round(r["similarity"], 6)) for r in dedup.jaccard_pairs(frame, threshold, block).collect()) == want


def test_template_match_takes_equal_sets(spark, tmp_path):
    """Orders of equal parts are pairs too, each with the score of its own hash, name and margins."""
    rows = [(k, p) for k, parts in {1: (1, 2), 2: (1, 2), 4: (1, 2, 3), 12: (1, 2), 40: (9,)}.items() for p in parts]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["id"], r["id2"]): (r["score"], r["level"]) for r in catalogue.queries()["template_match"](spark, str(tmp_path)).collect()}
    near = (0.666667, "none")
    assert got == {(1, 2): (1.0, "same"), (1, 12): (1.0, "same"), (2, 12): (0.97, "same"), (1, 4): near, (2, 4): (0.716667, "none"), (4, 12): (0.716667, "none")}


def test_knn_blocks(spark):
    from talentspark.operators import vector_index

    v = spark.createDataFrame([(i, [float(i % 5), float(i % 7)]) for i in range(40)], "id int, v array<double>")
    q = v.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector_index.nearest(q, v, 3, block=4).collect()}
    for i in range(0, 40, 4):
        want = sorted((-(i % 5) * (j % 5) - (i % 7) * (j % 7), j) for j in range(40) if j != i)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in want]


def test_communities(spark):
    e = [("g", a, b, 5) for x in ("abc", "xyz") for a in x for b in x if a < b] + [("g", "c", "x", 1)]
    got = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(e, "graph string, src string, dst string, weight int")).collect()}
    assert len({got[n] for n in "abc"}) == 1 and len({got[n] for n in "xyz"}) == 1 and got["a"] != got["x"]


def test_sections_and_quality(spark):
    d = spark.createDataFrame([(1, "SKILLS\na\nb\nWORK\nc"), (2, None)], "doc_id int, text string")
    head = (F.upper("line") == F.col("line")) & F.col("line").rlike("[A-Z]")
    assert [r["section"] for r in quality.sections(d, "doc_id", head).where("doc_id = 1").orderBy("pos").collect()] == ["SKILLS"] * 3 + ["WORK"] * 2
    assert one(spark, quality.ai_likeness(F.lit(None).cast("double"), F.lit(0.25), F.lit(0.3))) == 50


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "Positions.csv").write_text('Company Name,Title,Description,Location,Started On,Finished On\n"Acme, Inc",Dev,"a ""b""","London, UK",Jan 2020,\nOther,Op,,,Feb 2018,Dec 2019\n')
    (tmp_path / "Skills.csv").write_text("Name\nC#\nSQL\n")
    (tmp_path / "Endorsement_Received_Info.csv").write_text("Skill Name\nC#\nC#\nC#\n")
    got = readers.positions(spark, str(tmp_path)).orderBy("start_date").collect()
    assert got[1]["company"] == "Acme, Inc" and got[1]["is_current"] and str(got[0]["end_date"]) == "2019-12-01"
    assert {r["skill"]: r["endorsements"] for r in readers.endorsed_skills(spark, str(tmp_path)).collect()} == {"C#": 3, "SQL": 0}
    (tmp_path / "d.txt").write_text("# note\nC#: csharp, c sharp\n")
    assert {(r["alias"], r["canonical"]) for r in readers.dictionary(spark, str(tmp_path / "d.txt")).collect()} == {("c#", "c#"), ("csharp", "c#"), ("c sharp", "c#")}
    (tmp_path / "feed.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "Data engineer"}, {"id": 2, "title": "Cook"}]}))
    spark.dataSource.register(readers.JobBoard)
    assert [r["title"] for r in spark.read.format("jobboard").option("urls", f"file://{tmp_path}/feed.json").option("keyword", "engineer").load().collect()] == ["Data engineer"]
    p = spark.createDataFrame([(1, "Ann", "a@b.c")], "id int, name string, email string")
    k = spark.createDataFrame([(1, "db", "sql"), (1, "db", "kv")], "id int, category string, skill string")
    assert json.loads(writers.resume_json(p, k).first()["json"])["skills"] == [{"name": "db", "keywords": ["kv", "sql"]}]
    assert "- **db**: kv, sql" in writers.resume_markdown(p, k).first()["markdown"]


def test_tiered_match(spark):
    """Either string inside the other, whatever the case; synonyms; two words of a term in a text; strength decides, then the name."""
    led = spark.createDataFrame([(1, "Microsoft Azure", 0.5), (1, "SQL", 0.9), (1, "machine learning", 0.4), (1, "javascript", 0.3), (1, "k8s", 0.2), (2, "Go", 0.1)], "entity int, skill string, strength double")
    req = spark.createDataFrame([(7, t, 0) for t in ("azure", "sql", "machine learning", "java", "Kubernetes", "payment systems", "C", "rust")], "spec int, term string, importance int")
    names = spark.createDataFrame([("K8S", "kubernetes")], "alias string, canonical string")
    texts = spark.createDataFrame([(1, "Built Payment rails and billing systems"), (2, "payment only")], "entity int, text string")
    got = {(r["entity"], r["term"]): (r["skill"], r["similarity"]) for r in matching.best_entries(led, req, names, texts).collect()}
    assert got == {
        (1, "azure"): ("Microsoft Azure", 0.85), (1, "sql"): ("SQL", 0.85), (1, "machine learning"): ("machine learning", 0.85), (1, "java"): ("javascript", 0.85),
        (1, "Kubernetes"): ("k8s", 0.82), (1, "payment systems"): ("(evidence)", 0.65), (1, "C"): ("Microsoft Azure", 0.85),
    }
    specs = matching.spec_classes(req.unionByName(req.withColumn("spec", F.lit(9))))
    sets = matching.entity_sets(matching.best_entries(led, req, names, texts), specs)
    c = matching.coverage(sets, specs).collect()
    assert [(r["spec_class"], r["n_specs"], r["got_required"], r["n_required"]) for r in c] == [(7, 2, 7, 8)]
    assert {(r["spec"], r["entity"], r["rank"]) for r in matching.rank(sets, specs, 3).collect()} == {(7, 1, 1), (9, 1, 1)}
    tiers = matching.tiered_match(matching.best_entries(led, req, names, texts), req)
    assert tiers.count() == 7


def test_cosine_tier(spark):
    """Vectors decide only where strings and synonyms find nothing, the highest cosine first, ties by name; texts only where vectors find nothing."""
    led = spark.createDataFrame([(1, "Mongo", 0.2), (1, "Redis", 0.9), (1, "Excel", 0.5), (2, "Excel", 0.7), (2, "k8s", 0.1)], "entity int, skill string, strength double")
    req = spark.createDataFrame([(7, t, 0) for t in ("NoSQL", "excel sheets", "kubernetes", "payment systems", "Go")], "spec int, term string, importance int")
    names = spark.createDataFrame([("K8S", "kubernetes")], "alias string, canonical string")
    texts = spark.createDataFrame([(1, "payment systems"), (2, "payment systems")], "entity int, text string")
    at = {"mongo": [0.8, 0.6], "redis": [0.8, 0.6], "nosql": [1.0, 0.0], "excel": [0.0, 1.0], "excel sheets": [1.0, 0.0], "kubernetes": [1.0, 0.0], "k8s": [0.0, 1.0], "payment systems": [0.0, 1.0], "go": [-1.0, 0.0]}
    model = lambda c: F.element_at(F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), c)
    near = matching.near_terms(led.select("skill"), req.select("term"), model)
    dot = lambda s, t: sum(x * y for x, y in zip(at[s], at[t]))
    assert {(r["skill"], r["term"]) for r in near.collect()} == {(s, t) for s in ("mongo", "redis", "excel", "k8s") for t in ("nosql", "kubernetes", "excel sheets", "payment systems", "go") if dot(s, t) >= 0.58}
    got = {(r["entity"], r["term"]): (r["skill"], round(r["similarity"], 6)) for r in matching.best_entries(led, req, names, texts, near).collect()}
    assert got == {
        (1, "NoSQL"): ("Mongo", 0.8), (1, "excel sheets"): ("Excel", 0.85), (2, "excel sheets"): ("Excel", 0.85), (1, "kubernetes"): ("Mongo", 0.8), (2, "kubernetes"): ("k8s", 0.82),
        (1, "payment systems"): ("Excel", 1.0), (2, "payment systems"): ("Excel", 1.0), (1, "Go"): ("Mongo", 0.85),
    }


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abA ", max_size=6), max_size=8), st.lists(st.text("abA ", max_size=9), max_size=8))
def test_contained(spark, parts, wholes):
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "s string")
    got = {tuple(r) for r in matching.contained(frame(parts), frame(wholes)).collect()}
    assert got == {(p.lower(), w.lower()) for p in parts for w in wholes if p and p.lower() in w.lower()}


def test_by_distinct(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"Jan 20{10 + i % 2} - Present") for i in range(30)], "id int, text string")
    out = T.by_distinct(rows, "text", T.date_range, "r")
    assert out.columns == ["id", "text", "r"]
    plain = rows.withColumn("r", T.date_range(F.col("text")))
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def joined_rows(spark):
    """Most rows that a join of the last query gave, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for node in map(nodes.apply, range(nodes.size())):
        for m in map(node.metrics().apply, range(node.metrics().size())):
            if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_contained_numbered_names(spark):
    names = spark.range(2000).select(F.format_string("customer-%09d", "id").alias("s"))
    assert matching.contained(names, names).count() == 2000
    # Names with common runs of digits do not meet.
    assert 2000 <= joined_rows(spark) < 20_000


def test_contained_long(spark):
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "s string")
    a, b = "the same long beginning of many names, " * 2, "abcdefghij" * 5
    parts, wholes = [a, a + "1", b, "x", a[:32], a[:33]], [a + "1 and more", a + "2", "0" + b, a[:40], "q"]
    got = {tuple(r) for r in matching.contained(frame(parts), frame(wholes)).collect()}
    assert got == {(p, w) for p in parts for w in wholes if p in w}


def test_mail_match(spark):
    apps = spark.createDataFrame([(1, "Acme Inc", "Engineer", "jane@acme.com"), (2, "Google", "SRE", None), (3, "Microsoft Corp", "Data Engineer", None), (4, "Acme", "Cook", None)], "application_id int, company string, title string, recruiter string")
    mails = [
        (1, "Jane@Acme.com", "hi", ""), (2, "noreply@google.com", "hello", "x"), (3, "careers@microsoft.com", "Your Data Engineer application", "x"), (4, "x@google-mail.com", "SRE role", ""),
        (5, "jobs@careers.acme.co.uk", "Cook wanted", "come to ACME now"), (6, "me@hosting.example", "the cook", "from acmecorp"), (7, "me@hosting.example", "the cook", "nothing"), (8, "no address", "x", "y"),
    ]
    out = matching.mail_match(spark.createDataFrame(mails, "message_id int, sender string, subject string, body string"), apps)
    got = {r["message_id"]: (r["application_id"], round(r["score"], 2)) for r in out.collect()}
    assert got == {1: (1, 1.0), 2: (2, 0.6), 3: (3, 0.9), 4: (2, 0.9), 5: (4, 0.5), 6: (4, 0.5)}


def test_reposts(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [(1, "Acme", "Data Engineer Platform Team", day(0)), (2, "ACME", "Senior Data Engineer Platform Team", day(10)), (3, "acme", "Cook", day(11)), (4, "Acme", "Data Engineer Platform Team", day(90)), (5, "Other", "Cook", day(1)), (6, None, "Cook", day(2))]
    got = {r["job_id"]: (r["posts"], r["days"], r["likely"]) for r in dedup.reposts(spark.createDataFrame(rows, "job_id int, company string, title string, created date")).collect()}
    assert got == {2: (4, 10, True), 4: (4, 80, False)}


def test_small_rules(spark):
    assert one(spark, T.normalise_title(F.lit("Senior Lead Engineer"))) == "engineer" and one(spark, T.normalise_title(F.lit("Leadership Associate"))) == "leadership"
    assert one(spark, T.rewrite(F.lit("very really good, I my me just"))) == "good,"
    assert one(spark, T.words(F.lit("Élan vital, naïve"))) == ["élan", "vital", "naïve"]
    j = spark.createDataFrame([(1, ["SQL", "sql", "c"])], "job_id int, skills array<string>")
    r = matching.simple_match(j, ["Sql"], [], F.lit(0)).first()
    assert round(r["score"], 6) == round(2 / 3, 6) and r["missing"] == ["c"]
    for value, truth in ((F.lit(1), True), (F.lit(0), False), (F.lit("true"), True), (F.lit("x"), False), (F.lit(True), True)):
        assert one(spark, filters.compile_leaf(Leaf("f", "IsTrue"), {"f": value})) is truth and one(spark, filters.compile_leaf(Leaf("f", "IsFalse"), {"f": value})) is not truth
    long = spark.createDataFrame([(1, i, f"t{i:03}") for i in range(50)], "group int, position int, term string")
    assert graph.relations(long).count() == 4 * 46 + 3 + 2 + 1
    u = lambda rows: spark.createDataFrame(rows, "id int, version int, data string")
    assert [r["data"] for r in dedup.upsert(u([(1, 1, "a")]), u([(1, 1, "c"), (1, 1, "b")]), "id", "version").collect()] == ["b"]
    with pytest.raises(ValueError):
        graph.communities(spark.createDataFrame([("g", "a", "b", 1)], "graph string, src string, dst string, weight int"), most_edges=0)
    assert one(spark, matching.title_reflected(F.lit("Data Engineer"), F.lit("an engineer of things"))) and not one(spark, matching.title_reflected(F.lit("Data Cook"), F.lit("x")))
    assert one(spark, T.heading_class(F.lit("K E Y  S K I L L S"))) == "Skills" and one(spark, T.heading_class(F.lit("plain"))) is None
    assert "- b" in one(spark, ledger.tailoring_prompt(F.lit("Dev"), F.array(F.lit("a")), F.array(F.lit("b"))))


def test_more_sources(spark, tmp_path):
    (tmp_path / "Education.csv").write_text("School Name,Start Date,End Date,Notes,Degree Name,Activities\nMIT,2001,Jun 2005,,BSc,\n")
    (tmp_path / "Profile.csv").write_text('First Name,Last Name,Headline,Summary,Geo Location\nAnn,Lee,Dev,,"London, UK"\n')
    r = readers.education(spark, str(tmp_path)).first()
    assert (r["institution"], r["start_year"], r["end_year"]) == ("MIT", 2001, 2005) and readers.profile(spark, str(tmp_path)).first()["name"] == "Ann Lee"
    state = tmp_path / "state.json"
    state.write_text(json.dumps({"jobs": [{"id": "a", "title": "Dev"}, {"id": "b", "title": "Op"}]}))
    readers.migrate_state(spark, str(state), ["jobs"], str(tmp_path / "store"))
    got = readers.stored_records(spark, str(tmp_path / "store" / "jobs"), "id string, title string", "title").select("title").collect()
    assert [r["title"] for r in got] == ["Dev", "Op"]
    (tmp_path / "repos.json").write_text(json.dumps({"name": "r", "fork": False, "size": 50, "stargazers_count": 3, "pushed_at": "2024-01-02T03:04:05Z", "topics": ["x"], "languages": {"Python": 97, "C": 3}}) + "\n" + json.dumps({"name": "f", "fork": True, "size": 50}))
    r = readers.repositories(spark, str(tmp_path / "repos.json")).collect()
    assert [x["name"] for x in r] == ["r"] and [(x["language"], x["share"]) for x in r[0]["languages"]] == [("python", 0.97)] and str(r[0]["pushed"]) == "2024-01-02"
    (tmp_path / "roles.txt").write_text("# x\nDev|SQL\nDev | Go\n")
    (tmp_path / "levels.txt").write_text("Masters:DE:Diplom\n#no\n")
    (tmp_path / "words.txt").write_text("One\n# two\n\n")
    assert readers.role_skills(spark, str(tmp_path / "roles.txt")).count() == 2 and readers.level_terms(spark, str(tmp_path / "levels.txt")).first()["name"] == "diplom"
    assert [x["word"] for x in readers.word_list(spark, str(tmp_path / "words.txt")).collect()] == ["one"]
    parses = spark.createDataFrame([("f", "fast", 1, "a", 0.4), ("f", "slow", 2, "b", 0.7), ("g", "fast", 1, "c", 0.2)], "name string, parser string, priority int, text string, confidence double")
    assert [(x["name"], x["parser"]) for x in readers.chosen_parse(parses).collect()] == [("f", "slow")]
    assert one(spark, readers.is_profile_export(F.array(F.lit("x/Profile.csv"), F.lit("Skills.csv")))) and not one(spark, readers.is_profile_export(F.array(F.lit("a.txt"))))
    pages = spark.createDataFrame([(None, "<title>t</title>"), ("https://a.b/c", "<title>u</title>"), ("https://m.x/", "<title>v</title>")], "url string, html string")
    assert sorted(x["title"] for x in readers.job_pages(pages, ("m.x",)).collect()) == ["t", "u"]
    (tmp_path / "feed.json").write_text(json.dumps([{"id": 1, "title": "Développeur"}, {"id": 2, "title": "Cook"}]))
    spark.dataSource.register(readers.JobBoard)
    assert [r["title"] for r in spark.read.format("jobboard").option("urls", f"file://{tmp_path}/feed.json").option("keyword", "développeur").load().collect()] == ["Développeur"]
    writers.snapshot(parses, str(tmp_path / "snap"))
    writers.snapshot(parses.limit(1), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1
    lines = writers.dictionary_lines(spark.createDataFrame([("c", "see"), ("c", "sea"), ("a", "ay")], "canonical string, alias string"))
    assert [r["value"] for r in lines.collect()] == ["a: ay", "c: sea, see"]


def test_similar_across_groups(spark):
    """Near vectors of different groups meet, in several blocks."""
    from talentspark.operators import vector_index

    v = spark.createDataFrame([(i, [1.0, 0.1 * i], i % 3) for i in range(9)], "id long, v array<double>, group long")
    q = v.where("id < 4").selectExpr("id as query_id", "v as q")
    got = {(r["query_id"], r["id"]) for r in vector_index.reaching(q, v, 1.06, block=4).collect()}
    assert got == {(a, b) for a in range(4) for b in range(9) if a != b and 1 + 0.01 * a * b >= 1.06} and any((a - b) % 3 for a, b in got)


def test_similar_within_blocks(spark):
    """Pairs within a group over several blocks, with vectors that are missing, zero, of other lengths or with a missing number."""
    import numpy as np

    from talentspark.operators import search

    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(c) for c in rng.normal(size=3)]) for i in range(60)] + [(60, 0, None), (61, 0, [0.0] * 3), (62, 0, [9.0] * 2), (63, 0, [9.0] * 2), (64, 0, [9.0, None, 9.0]), (66, 0, [2.0]), (67, 0, [2.0, 1.0, 1.0, float("inf")]), (68, 0, [1.0, 1.0, 1.0, None]), (65, None, [9.0] * 3), (3, 1, [9.0] * 3)]
    got = search.similar_within(spark.createDataFrame(rows, "id long, g int, v array<double>"), "g", 0.5, block=7).collect()
    pairs = [(g, a, b, list(zip(v, w))) for a, g, v in rows for b, h, w in rows if g is not None and g == h and a < b and v is not None and w is not None]
    dots = [(g, a, b, sum(x * y for x, y in p)) for g, a, b, p in pairs if all(None not in xy for xy in p)]
    assert sorted((r["g"], r["a"], r["b"], round(r["similarity"], 6)) for r in got) == sorted((g, a, b, round(s, 6)) for g, a, b, s in dots if s >= 0.5)


def test_jaccard_candidates_lose_no_pair(spark):
    """Sets of any size meet as all pairs do; of small sets hardly a pair that is not similar is left to compare by items."""
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(12), rng.randint(1, 7))) for i in range(60)} | {100 + i: set(rng.sample(range(420), 400 - i)) for i in range(6)}
    sets |= {200 + i: {1000, *range(2000 + 10 * i, 2004 + 10 * i)} for i in range(200)}
    c = dedup.set_classes(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id int, items array<int>"))
    found = {(r["id"], r["id2"]) for r in dedup.jaccard_candidates(c, 0.5).collect()}
    ids = [r["id"] for r in c.collect()]
    similar = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert similar <= found and len(found - similar) < 100


def test_equal_texts_are_read_once(spark, monkeypatch):
    """The words of texts that are equal but for case are looked up once, for phrases as for achievements."""
    seen = []
    monkeypatch.setattr(matching, "contained", lambda parts, wholes, own=matching.contained: seen.append(wholes.count()) or own(parts, wholes))
    texts = spark.createDataFrame([(i, "Red gear job" if i % 2 else "RED GEAR JOB") for i in range(50)] + [(99, None), (98, "")], "entity int, text string")
    terms = spark.createDataFrame([("Red Gear",), ("job",)], "term string")
    assert {r["phrase"] for r in matching.mentioned(terms, texts.select("text")).collect()} == {"red gear", "job"}
    got = matching.from_achievements(spark.createDataFrame([("gear wheel",), ("gear",)], "term string"), texts).collect()
    assert {(r["entity"], r["term"]) for r in got} == {(i, "gear") for i in range(50)}
    assert seen == [3, 3]


def test_ledger_shuffles_its_evidence_once(spark):
    """All of a ledger comes from one exchange of the evidence; dealt by entity before, it is not dealt again."""
    day = dt.date
    rows = [
        (1, 1, 1, "sql", "c", day(2000, 1, 1), day(2000, 3, 1), 0.5, "R"), (1, 1, 2, "sql", "c", day(2000, 1, 1), day(2000, 3, 1), 0.4, "N"), (1, 2, 1, "sql", "b", None, day(2001, 1, 1), 0.9, "N"),
        (1, None, 3, "sql", "d", day(2000, 6, 1), None, 0.1, "A"), (1, 2, 2, "go", "d", None, None, 0.2, "N"), (1, 3, 1, "c", "x", day(2001, 5, 1), day(2001, 5, 1), 0.3, "N"), (1, 4, 1, "c", "x", day(2001, 4, 1), day(2001, 5, 1), 0.3, "N"),
    ]
    e = spark.createDataFrame(rows, EV)
    for x in (e, e.repartition("entity")):
        led = ledger.build_ledger(x, "2002-01-01")
        assert led._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = {r["skill"]: (r["evidence_count"], r["role_count"], round(r["years"] * 365.25), r["first_seen"], r["last_seen"], r["is_current"], r["unsubstantiated"], r["category"]) for r in led.collect()}
        assert got == {
            "sql": (4, 3, 60 + 579, day(2000, 1, 1), None, True, False, "b"), "go": (1, 1, 0, None, None, True, True, "d"),
            "c": (2, 2, 30, day(2001, 4, 1), day(2001, 5, 1), False, False, "x"),
        }
    union = {(r["skill"], r["islands"], r["days"]) for r in ledger.interval_union(e, "2002-01-01").collect()}
    assert union == {("sql", 2, 639), ("c", 1, 30)}


def test_order_lines(spark, tmp_path):
    """Evidence, achievements and requirements of lines joined once are those of the tables, a line without its order and one without its part among them."""
    from talentspark.plans import bindings

    lines = [(o, p, s, n, q, 0.1 * n, f, st) for o, p, s, n, q, f, st in ((1, 1, 1, 1, 3.0, "R", "F"), (1, 2, 2, 2, 5.5, "A", "O"), (2, 1, 3, 1, 1.0, "N", None), (9, 2, 4, 1, 1.0, "R", "F"), (2, 9, 4, 2, 1.0, "R", "F"))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, dt.datetime(1999, 1, 2, 3)), (2, 8, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "red gear", "PROMO", 41), (2, "hot bolt", "ECONOMY", 14)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    joined = bindings.order_lines(spark, str(tmp_path))
    for of, own, n in ((bindings.evidence_of, bindings.evidence, 3), (bindings.achievements_of, bindings.achievements, 3), (bindings.requirements_of, bindings.requirements, 4)):
        want = own(spark, str(tmp_path))
        got = of(joined).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == n


def test_match_deals_no_ledger_for_a_small_vocabulary(spark):
    """Pairs of the vocabulary are written, so entries and texts meet them without being shuffled; only the entries of each term are."""
    led = writers.written(spark.createDataFrame([(i, "red gear", 0.1 * i) for i in range(5)] + [(5, "rope", 0.7)], "entity int, skill string, strength double"), "ledger")
    req = spark.createDataFrame([(1, "GEAR", 0), (2, "wheel", 1)], "spec int, term string, importance int")
    texts = writers.written(spark.createDataFrame([(5, "a wheel job"), (0, "wheel"), (9, "wheel")], "entity int, text string"), "texts")
    rows = []
    own = matching.written

    def kept(df, name):
        rows.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return own(df, name)

    matching.written = kept
    try:
        got = {(r["entity"], r["term"]): (r["skill"], r["strength"], r["similarity"]) for r in matching.best_entries(led, req, None, texts).collect()}
    finally:
        matching.written = own
    assert got == {(i, "GEAR"): ("red gear", pytest.approx(0.1 * i), 0.85) for i in range(5)} | {(5, "wheel"): ("(evidence)", 0.7, 0.65), (0, "wheel"): ("(evidence)", 0.0, 0.65)}
    plan = dict(rows)["best"]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 2
