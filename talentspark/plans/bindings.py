"""Bindings of the operators' column roles to tables: evidence, requirements, postings, applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated, sourced evidence of a skill: entity, experience, seq, skill, category, start_date, end_date, confidence, source."""
    start = F.to_date("o_orderdate")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("experience"), F.col("l_linenumber").alias("seq"),
        F.col("p_name").alias("skill"), F.col("p_type").alias("category"), start.alias("start_date"),
        F.when(F.col("l_linestatus") != "O", F.date_add(start, (F.col("l_quantity") * 10).cast("int"))).alias("end_date"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("source"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with its order and part: what evidence, requirements and achievements are taken from where a query needs them all.

    A line without its order is there for requirements only; its experience is null.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_suppkey").alias("spec"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_linestatus") != "O", (F.col("l_quantity") * 10).cast("int")).alias("held"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("source"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experience"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("start_date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("skill"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))
    x = lines.join(orders, F.col("l_orderkey") == F.col("experience"), "left").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return x.select("entity", "experience", "seq", "skill", "category", "size", "start_date", F.expr("date_add(start_date, held)").alias("end_date"), "confidence", "source", "spec")


def evidence_of(lines: DataFrame) -> DataFrame:
    """``evidence`` from ``order_lines``."""
    return lines.where(F.col("experience").isNotNull()).drop("size", "spec")


def achievements_of(lines: DataFrame) -> DataFrame:
    """``achievements`` from ``order_lines``."""
    return lines.where(F.col("experience").isNotNull()).select("entity", (F.col("experience") * 10 + F.col("seq")).alias("seq"), _told("skill", "size").alias("text"))


def requirements_of(lines: DataFrame) -> DataFrame:
    """``requirements`` from ``order_lines``."""
    return lines.groupBy("spec", _term("spec", "skill").alias("term")).agg(F.min(_importance("source")).alias("importance"))


def _told(name: str, size: str) -> Column:
    return F.concat(name, F.when(F.col(size) > 40, " Assembly line").when(F.col(size) % 7 == 0, " design").otherwise(" job"))


def _importance(flag: str) -> Column:
    return F.when(F.col(flag) == "R", 0).when(F.col(flag) == "A", 1).otherwise(2)


def _term(spec: str, name: str) -> Column:
    kind, noun = F.col(spec) % 4, _noun(name)
    return F.when(kind == 0, F.upper(noun)).when(kind == 1, F.concat(noun, F.lit(" assembly"))).when(kind == 2, F.concat(F.lit("Red "), F.upper(noun), F.lit(" design"))).otherwise(F.reverse(noun))


def _noun(name: str = "p_name") -> Column:
    return F.element_at(F.split(name, " "), -1)


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (spec, term): the most important of its mentions (0 required, 1 preferred, 2 inferred).

    Specs spell a part in one of four ways: in capitals, as two words of which one is no skill, as a
    longer phrase around a skill, or by an alias.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_suppkey").alias("spec"), _term("l_suppkey", "p_name").alias("term")).agg(F.min(_importance("l_returnflag")).alias("importance"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of skills: a part's noun backwards stands for its red kind."""
    return table(spark, sf_dir, "part").select(F.initcap(F.reverse(_noun())).alias("alias"), F.concat(F.lit("red "), _noun()).alias("canonical")).distinct()


def achievements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an entity did, in order: entity, seq, text."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("o_custkey").alias("entity"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), _told("p_name", "p_size").alias("text"))


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, term) where the entity has a skill of the category the term is first met in."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    home = requirements(spark, sf_dir).select("term").distinct().join(lines.groupBy(_noun().alias("noun")).agg(F.min("p_type").alias("category")), F.lower("term").contains(F.col("noun")))
    return evidence(spark, sf_dir).select("entity", "category").distinct().join(home.select("term", "category"), "category").select("entity", "term")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job postings: id, company, title, salary, tri-state remote, created, fetched order and skills of the order's lines."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("job_id"), F.concat_ws(" ", "c_mktsegment", "n_name").alias("company"), F.col("n_name").alias("location"),
        F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("salary"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("is_remote"),
        F.to_date("o_orderdate").alias("created"), F.col("o_custkey").alias("source_id"),
    )


def posting_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted skills a posting asks for."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_set("p_name")).alias("skills"))


#: Stage order of an application (fixed values).
STAGES = ("Saved", "Applied", "Screening", "Interview", "Offer", "Accepted", "Rejected", "Withdrawn", "Ghosted")
EVENT_STAGE = {"signup": 0, "view": 1, "click": 2, "purchase": 4, "error": 6}


def application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events of applications; an application is a user's day."""
    stage = F.lit(None).cast("int")
    for name, k in EVENT_STAGE.items():
        stage = F.when(F.col("event_type") == name, F.lit(k)).otherwise(stage)
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", F.to_date("ts")).alias("application"), "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), stage.alias("to_stage"), "event_type", "value"
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up- and down-votes on an aspect: purchases and clicks count up, errors and signups down."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "view")
    return e.select(F.col("user_id").alias("profile"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(-1).alias("delta"))
