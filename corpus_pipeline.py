"""Corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

1. quality classifier: documents whose top grade is unlikely go;
2. MinHash near-dedup: one document of each class stays, the one of least id;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: every reported span is replaced by a mark, ``n_chars`` follows;
5. packing: the texts become token pieces placed in sequences.

All but the last return the columns of ``documents``. Each stage has its
operator's treatment of nulls, empty texts and repeated rows, except that
packing and decontamination keep rows with a null id, and near-dedup keeps all of them.

Every stage sets the session's Arrow batches to ``BATCH_ROWS`` rows: a batch of texts is held several times
over, by the executor and by each of its Python workers, and the default of 10,000 rows knows no bound on bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontamination, near_dedup, packing, quality_classifier, secret_scan
from parley.llm.common import durable
from parley.llm.queries import tokenizer_files

#: The classifier's training and near-dedup's iterations have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


#: Texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with the session set to batches of ``BATCH_ROWS``."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.select_rows(docs, quality_classifier.train(docs, quality_classifier.grades(labels)))


@in_batches
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@in_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_counted(docs)


@in_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
