"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

All stages but the last return the columns of ``documents``, whatever others there are beside ``doc_id``
and ``text``.  Null and empty texts pass all stages (and are packed as their end token); rows with a null
``doc_id`` are never taken for copies or contaminated and stay; of rows that repeat a ``doc_id`` each
distinct text stays once; of texts that tie as near-duplicates the one with the smallest ``doc_id`` stays.
Very long texts are read whole.  Without labels nothing is rejected as toxic; an empty benchmark
contaminates nothing; empty documents give an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontamination, minhash, packing, pii, toxicity
from gridloom.session import remove, shared_dir


def few_rows(spark: SparkSession) -> None:
    """Arrow batches of a thousand texts: ten thousand, some of them long, crowd the executors' memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    few_rows(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    few_rows(spark)
    return minhash.deduplicated(docs, percent=80).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    few_rows(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    few_rows(spark)
    return pii.redact(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and offset."""
    few_rows(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: No SQL expresses the fitted stages; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written and read again for the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # its successor is written
        before = path
    return docs
