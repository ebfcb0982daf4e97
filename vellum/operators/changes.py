"""Change log of documents and folders, latest state, and the index that follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking

FIELDS = ("title", "content", "folder_id")


def insertions(documents: DataFrame, ts: Column) -> DataFrame:
    """Log rows that create documents, version 1, all fields set."""
    return documents.select(
        "id", F.lit(1).alias("version"), F.lit("create").alias("op"), *FIELDS, *[F.lit(True).alias(f"{f}_set") for f in FIELDS], F.lit(True).alias("is_active"), ts.alias("ts")
    )


def apply_patches(documents: DataFrame, patches: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Documents with the fields that a patch sets, be it to null; unset fields and unknown ids change nothing."""
    p = patches.select(F.col("id").alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(f"{f}_set").alias(f"_{f}_set") for f in fields], F.col("ts").alias("_ts"))
    new = {f: F.when(F.coalesce(f"_{f}_set", F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields}
    new["updated_at"] = F.coalesce("_ts", "updated_at").alias("updated_at")
    return documents.join(p, F.col("id") == F.col("_id"), "left").select(*[new.get(c, F.col(c)) for c in documents.columns])


def soft_delete(documents: DataFrame, ids: DataFrame, ts: Column) -> DataFrame:
    """Mark documents inactive; that is an update too."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    hit = F.col("_gone").isNotNull() & F.col("is_active")
    new = {"is_active": (F.col("is_active") & ~hit).alias("is_active"), "updated_at": F.when(hit, ts).otherwise(F.col("updated_at")).alias("updated_at")}
    return documents.join(gone, F.col("id") == F.col("_gone"), "left").select(*[new.get(c, F.col(c)) for c in documents.columns])


def latest(log: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """State after all changes: each field's last set value, also if that is null."""
    last = lambda c, on: F.max_by(F.struct(F.col(c)), F.when(on, F.col("version")))[c].alias(c)
    return log.groupBy("id").agg(
        *[last(f, F.col(f"{f}_set")) for f in fields],
        last("is_active", F.col("is_active").isNotNull()),
        F.max("version").alias("version"),
        F.min("ts").alias("created_at"),
        F.max(F.when(F.col("version") > 1, F.col("ts"))).alias("updated_at"),
    )


def index_rows(log: DataFrame, replace: bool = True, chunker=chunking.fixed_chunks) -> DataFrame:
    """Chunks that the index holds after all changes, with the version they come from.

    Only changes that set the content are indexed, and chunks of deleted documents go.
    With ``replace`` a new content's chunks take the place of the old ones; without, they
    pile up.
    """
    written = log.filter("content_set")
    if replace:
        written = written.groupBy("id").agg(F.max_by(F.struct("title", "content", "version"), "version").alias("_w")).select("id", "_w.*")
    titles = latest(log).filter("is_active").select("id", F.col("title").alias("_title"))
    rows = written.join(titles, "id").withColumn("title", F.col("_title"))
    return chunker(rows, carry=("version",))
