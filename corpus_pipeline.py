"""A training corpus from raw documents, in five stages of the text operators.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
items go, secrets are replaced, and what is left is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import pieces, secrets, simhash, tiling, toxicity
from braidwork.llm.common import DOCUMENT_COLUMNS, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled documents, does not reject."""
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash links, the one of smallest id."""
    return simhash.keep_one(docs.select(*DOCUMENT_COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a benchmark item, in whatever order its parts come."""
    return tiling.decontaminate(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and their length brought up to date."""
    clean = secrets.redact(docs.select(*DOCUMENT_COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left."""
    return pieces.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither a trained model nor the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet and read by the next.

    The tables go to a new folder in the cluster's shared checkpoint folder. Each is removed when the
    next one is written; the last, which the result reads, stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        to = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(to), to
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
