"""Small helpers shared by the operators: tables, lineage cuts, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside; put back at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def held_out(doc_id: str, modulus: int, remainder: int):
    """True for rows whose crc32(id as text) leaves ``remainder``: never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus == remainder


def worker_cache(key: Any, build: Callable[[], Any], most: int = 2) -> Any:
    """``build()`` once per Python worker process, kept across its tasks; the ``most`` things used last stay."""
    holder = sys.modules.setdefault("_talentspark_worker", types.ModuleType("_talentspark_worker"))
    kept = holder.__dict__.setdefault("kept", OrderedDict())
    if key not in kept:
        kept[key] = build()
    kept.move_to_end(key)
    while len(kept) > most:
        kept.popitem(last=False)
    return kept[key]


#: Arrow types of the columns that operators add.
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def add_columns(documents: DataFrame, added: str, start: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """Columns ``added`` (a schema such as ``"n long, h string"``) in place of ``text``; all others go by untouched.

    ``start()`` runs once a task and gives the function from whole texts to the new columns.  The other
    columns stay Arrow arrays, so ids of any size and nulls come out as they went in.
    """
    kept = [f for f in documents.schema.fields if f.name != "text"]
    new = [x.split() for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in batches:
            out = compute(texts_of(b))
            old = [b.column(b.schema.get_field_index(f)) for f in names]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(out[n], _TYPES[t]) for n, t in new)], names=[*names, *(n for n, _ in new)])

    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    return documents.mapInArrow(run, schema)


def keep_rows(documents: DataFrame, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows, with all their columns as they are, for whose whole text the function from ``start()`` gives true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for b in batches:
            yield b.filter(pa.array(np.asarray(keep(texts_of(b)), dtype=bool)))

    return documents.mapInArrow(run, documents.schema)


def replace_text(documents: DataFrame, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows with a new ``text``, all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(change(texts_of(b)), b.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)


def labelled_sample(
    labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int
) -> DataFrame:
    """At most ``per_class`` ids of each label value, in order of a hash of the id.

    The bound is ``2 * per_class`` narrow rows whatever the table's size, so the
    result may be broadcast.  Rows with a null id or label, and repeated ids after
    the first, are left out.
    """
    rows = labels.where(~held_out("doc_id", modulus, remainder)).where(F.col(label).isin(0, 1))
    rows = rows.select("doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    one = [rows.where(F.col("y") == v).orderBy("h", "doc_id").limit(per_class) for v in (0, 1)]
    return one[0].unionByName(one[1]).dropDuplicates(["doc_id"]).select("doc_id", "y")
