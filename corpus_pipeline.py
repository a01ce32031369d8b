"""A training corpus from ``documents``: five stages, each one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again, so that a lost executor
costs its own stage only. All stages but the last return the columns of
``documents``; the last adds the mixing columns to the documents it samples.

Defined results of every stage: rows with null id, language, source or text are
judged like any other (a null text goes in the first stage); rows that are equal
in all columns are one from the near-dedup stage on, before it each stays; ties
go to the smallest id; an empty table stays empty; further columns pass, whatever
their names (but those named as a mixing result, which the last stage replaces).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from admitflow.llm.decontam import decontaminate
from admitflow.llm.langid import keep_identified
from admitflow.llm.mixing import mix
from admitflow.llm.secret_scan import redact
from admitflow.llm.simhash import keep_one
from admitflow.session import checkpoint_dir, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null and empty texts, texts without letters, and those under half a chance. The classifier is fitted on all labelled ones outside the test fold."""
    return keep_identified(docs, sample_docs=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (5-word shingles, similarity 0.8): the one of the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and n_chars follows the text where it has changed. No document goes."""
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights, with the mixing columns."""
    return mix(docs).where("mix_sampled").drop("mix_sampled")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: Fingerprints, fitted classifiers and alignments can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
