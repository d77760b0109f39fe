"""Corpus pipeline: language, toxicity, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but
the last return the columns of ``documents``.  A stage's result is written as Parquet in the
shared folder and read again, so a lost executor repeats one stage at most.

Defined cases, for every stage: a null text counts as empty (and stays null where the row
stays); null and repeated ids are rows like any other, each with its own decision; ids and
other numbers come out as they went in; texts of any length are read whole; equal texts
get equal decisions in the row-wise stages; an empty table gives an empty table; extra
columns of any name are passed on by all stages but the last, which reads ``doc_id`` and
``text`` only.  A text without a letter has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talentspark.llm import language_id, packing, pii_crf, shingle_dedup, toxicity
from talentspark.llm.entry import tokenizer
from talentspark.llm.runtime import materialize, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, at a posterior of one half or more."""
    return language_id.keep_known(docs, language_id.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of texts linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    return shingle_dedup.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii_crf.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
