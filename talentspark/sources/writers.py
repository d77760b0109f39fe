"""Sinks: snapshots, JSON and Markdown exports of profiles, learned dictionaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where none is set and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: what follows neither repeats their plan nor loses them with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """Replace a table; the committer makes the new files visible together."""
    df.write.mode("overwrite").parquet(path)


def resume_json(profiles: DataFrame, skills: DataFrame) -> DataFrame:
    """One JSON document a profile(id, name, email), skills(id, category, skill) grouped into keyword lists."""
    groups = skills.groupBy("id", "category").agg(F.array_sort(F.collect_set("skill")).alias("keywords"))
    lists = groups.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("category").alias("name"), "keywords"))).alias("skills"))
    basics = F.struct("name", "email").alias("basics")
    return profiles.join(lists, "id", "left").select("id", F.to_json(F.struct(basics, "skills")).alias("json"))


def resume_markdown(profiles: DataFrame, skills: DataFrame) -> DataFrame:
    groups = skills.groupBy("id", "category").agg(F.array_join(F.array_sort(F.collect_set("skill")), ", ").alias("k"))
    lines = groups.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- **"), "category", F.lit("**: "), "k"))), "\n").alias("lines"))
    return profiles.join(lines, "id", "left").select("id", F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.lit(""), F.lit("## Skills"), F.coalesce("lines", F.lit(""))).alias("markdown"))


def dictionary_lines(relations: DataFrame) -> DataFrame:
    """``canonical: alias, alias`` lines, sorted, ready for write.text."""
    g = relations.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("a"))
    return g.select(F.concat("canonical", F.lit(": "), "a").alias("value")).orderBy("value")


def export_state(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_state(spark, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables ``export_state`` wrote, read by their schemas."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
