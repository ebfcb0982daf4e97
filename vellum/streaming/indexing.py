"""Work that follows document changes: index upkeep and audit, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit, chunking
from ..sources import store


def follow_changes(log: DataFrame, chunk_path: str, gone_path: str, audit_path: str, checkpoint: str, chunker=chunking.chunk_documents, **trigger) -> StreamingQuery:
    """Store chunks of set contents with their version, deletions, and audit rows of all changes.

    Every batch has a folder of its own in each table, which a batch that is run again writes
    anew, so nothing is stored twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        store.write_batch(chunker(batch.filter("content_set"), carry=("version",)), chunk_path, number)
        store.write_batch(batch.filter("op = 'delete'").select(F.col("id").cast("long").alias("doc_id"), "version"), gone_path, number)
        store.write_batch(audit.audit_rows(batch), audit_path, number)
        batch.unpersist()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_index(spark: SparkSession, chunk_path: str, gone_path: str) -> DataFrame:
    """The chunks of each document's last content, but for documents deleted after it."""
    chunks = spark.read.parquet(chunk_path)
    last = chunks.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("version").alias("_last"))
    gone = spark.read.parquet(gone_path).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("version").alias("_gone"))
    live = last.join(gone, "_doc", "left").filter("_gone IS NULL OR _gone < _last").select("_doc", "_last")
    return chunks.join(live, (F.col("doc_id") == F.col("_doc")) & (F.col("version") == F.col("_last")), "left_semi")
