"""Landed files, plug-points, lookups and small graphs on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from talentspark.functions import embedding as E
from talentspark.operators import graph, records
from talentspark.sources import readers, writers


def test_landed_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in {"a.txt": "SKILLS\nx\nWORK\n", "b.md": "# One\n## Two\n", "c.html": "<p>hi</p><script>x</script>", "d.pdf": "no"}.items():
        (tmp_path / "docs" / name).write_text(text)
    got = {r["name"]: (r["kind"], r["text"], r["confidence"]) for r in readers.profile_files(spark, str(tmp_path / "docs")).collect()}
    assert set(got) == {"a.txt", "b.md", "c.html"} and got["a.txt"][2] == 0.65 and got["b.md"][2] == 0.75 and got["c.html"][1:] == ("hi", 0.6)
    (tmp_path / "m.eml").write_text("From: Jane <jane@acme.com>\nSubject: Hello there\nMessage-ID: <1@x>\nDate: Mon, 1 Jan 2024 10:00:00 +0000\n\nBody " + "x" * 600)
    m = readers.landed_mail(spark, str(tmp_path / "m.eml")).first()
    assert (m["message_id"], m["sender"], m["subject"], str(m["date"]), len(m["body_preview"])) == ("1@x", "jane@acme.com", "Hello there", "2024-01-01 10:00:00", 500)
    item = "<item><guid>{}</guid><title><![CDATA[{}]]></title><link>https://x/{}</link><description>&lt;b&gt; text</description></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format(1, "Dev <b>", 1) + item.format(2, "Cook", 2) + "</channel></rss>")
    assert sorted((r["external_id"], r["title"]) for r in readers.job_rss(spark, str(tmp_path / "f.xml")).collect()) == [("1", "Dev <b>"), ("2", "Cook")]
    assert readers.job_rss(spark, str(tmp_path / "f.xml"), "cook", 5).first()["external_id"] == "2"
    (tmp_path / "rules.json").write_text(json.dumps({"legal": [["license", 2]]}))
    assert readers.rules_from_json(spark, str(tmp_path / "rules.json")) == {"legal": (("license", 2),)}
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    writers.export_state({"t": t}, str(tmp_path / "state"))
    assert sorted(writers.import_state(spark, str(tmp_path / "state"), {"t": "id int, x string"})["t"].collect()) == sorted(t.collect())


def test_embeddings(spark):
    d = spark.createDataFrame([(1, "sql and go"), (2, "go, SQL and"), (3, None), (4, "")], "id int, text string")
    v = {r["id"]: r["embedding"] for r in E.embed_distinct(d, "text").collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1) and not any(v[4])
    row = spark.range(1).select(E.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), E.mean_pool(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)))).alias("m")).first()
    assert row["s"] == [0.5, 0.5] and row["m"] == [2.0, 4.0]


def test_lists_and_lookups(spark):
    x = spark.range(1).select(records.union_ignoring_case(F.array(F.lit("Go"), F.lit("go")), F.array(F.lit("SQL"), F.lit("GO"))).alias("x")).first()["x"]
    assert x == ["Go", "SQL"]
    docs = spark.createDataFrame([(1, "At ACME, Inc. in New York"), (2, "acmecorp of yorkshire"), (3, None)], "doc_id int, text string")
    names = spark.createDataFrame([("Acme", "company"), ("York", "location")], "name string, kind string")
    assert {(r["doc_id"], r["name"]) for r in records.entity_lookup(docs, "doc_id", names).collect()} == {(1, "Acme"), (1, "York"), (2, "York")}
    e = spark.createDataFrame([(1, "db", 2, 0, 1), (1, "web", 0, 1, 0), (2, "db", 0, 0, 0)], "entity int, domain string, skills int, titles int, texts int")
    got = {(r["entity"], r["domain"]): round(r["share"], 3) for r in records.domain_points(e).collect()}
    assert got == {(1, "db"): 1.0, (1, "web"): 0.714, (2, "general"): 0.5}


def test_graph_weights_and_projection(spark):
    t = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "c", 1), (2, "a", 0), (2, "b", 1)], "spec int, term string, importance int")
    edges = graph.cooccurrence_of_specs(t)
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1}
    assert graph.projection(edges).count() == 3
    with pytest.raises(ValueError):
        graph.projection(edges, most_nodes=2)


def test_communities_cannot_be_improved(spark):
    """No single move of a node to another community raises modularity, by brute force."""
    import random

    rng = random.Random(3)
    w = {(a, b): rng.randint(1, 9) for a in range(14) for b in range(a + 1, 14) if rng.random() < (0.8 if a // 5 == b // 5 else 0.1)}
    frame = spark.createDataFrame([("g", f"n{a:02}", f"n{b:02}", x) for (a, b), x in w.items()], "graph string, src string, dst string, weight int")
    home = {int(r["node"][1:]): r["community"] for r in graph.communities(frame).collect()}
    m = sum(w.values())
    degree = {n: sum(x for e, x in w.items() if n in e) for n in home}

    def modularity(home):
        inside = sum(x for (a, b), x in w.items() if home[a] == home[b]) / m
        return inside - sum((sum(degree[n] for n in home if home[n] == c) / 2 / m) ** 2 for c in set(home.values()))

    best = modularity(home)
    assert best > 0.2 and all(modularity(home | {n: c}) <= best + 1e-9 for n in home for c in set(home.values()))
