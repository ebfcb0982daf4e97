"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last returns the packing. Stages are tied by Parquet files,
written to the shared folder and read again, so that each starts from a short lineage.

Defined cases are those of the operators: rows without an id stay through deduplication,
null texts are clean, wordless texts are copies of each other, repeated rows are copies,
an empty table gives no rows, and further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontam, nearcopies, packing, secrets, toxicity
from vellum.llm.common import shared_path, text_fold

#: Documents from this toxicity score on go.
TOXIC = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels are learned from four of five folds."""
    labels = _table(spark, sf_dir, "labels").filter(text_fold("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels), threshold=TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, 0.8), that of the smallest id."""
    return nearcopies.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontam.drop_leaking(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secret_redaction", redact_secrets),
    ("best_fit_packing", pack),
]

#: Trained scores, iterative components and greedy packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
