"""Views of the synthetic tables in the shape of the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MINUTE0 = "2024-01-01 00:00:00"
TTL_S = 3600


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _after(ts: F.Column, **parts: F.Column) -> F.Column:
    return ts + F.make_dt_interval(**parts)


def documents_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    created = _after(F.lit(MINUTE0).cast("timestamp_ntz"), mins=i.cast("int"))
    return d.select(
        i.alias("id"),
        F.when(i % 17 == 0, "").when(i % 23 == 0, "Untitled").otherwise(F.concat(F.lit("Doc "), (i % 400).cast("string"))).alias("title"),
        F.col("text").alias("content"),
        F.nullif(F.substring("source", 4, 10).cast("int"), F.lit(0)).alias("folder_id"),
        (i % 11 != 10).alias("is_active"),
        created.alias("created_at"),
        F.when(i % 3 != 0, _after(created, hours=(i % 7).cast("int"))).alias("updated_at"),
    )


def folders_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("int").alias("id"), F.col("r_name").alias("title"), F.lit(None).cast("int").alias("parent_id"), F.lit(True).alias("is_active")
    )
    nations = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 6).cast("int").alias("id"),
        F.col("n_name").alias("title"),
        (F.col("n_regionkey") + 1).cast("int").alias("parent_id"),
        (F.col("n_nationkey") % 11 != 10).alias("is_active"),
    )
    return regions.unionByName(nations)


def system_logs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("action"),
        F.lit("DOCUMENT").alias("resource_type"),
        F.get_json_object("props", "$.k").alias("resource_id"),
        F.col("props").alias("details"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("status"),
    )


def requests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    micros = F.round(F.col("value") * 1000).cast("long")
    return read(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))).alias("end_ts"),
        F.when(e % 9 == 0, "/static/x").when(e % 9 == 1, "/health").otherwise(F.concat(F.lit("/documents/"), F.col("user_id").cast("string"))).alias("url"),
    )


def edits_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        "ts",
        F.col("event_id").alias("edit_id"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("content"),
        (F.col("event_id") % 13 == 0).alias("is_composing"),
    )


def cache_ops_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_id"),
        F.col("event_type").alias("key"),
        F.when(F.col("event_id") % 3 == 0, "put").when(F.col("event_id") % 7 == 3, "delete").otherwise("get").alias("op"),
        "ts",
        F.col("value"),
        F.lit(TTL_S).alias("ttl_s"),
    )


def changes_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log: create v1 of all, patch v2 of every fourth, delete v3 of the inactive."""
    d = documents_v(spark, sf_dir)
    i, none = F.col("id"), lambda kind: F.lit(None).cast(kind)

    def change(rows: DataFrame, version: int, op: str, title, content, folder, sets: tuple, active) -> DataFrame:
        return rows.select(
            "id",
            F.lit(version).alias("version"),
            F.lit(op).alias("op"),
            title.alias("title"),
            content.alias("content"),
            folder.alias("folder_id"),
            *[s.alias(n) for n, s in zip(("title_set", "content_set", "folder_id_set"), sets)],
            active.alias("is_active"),
            _after(F.col("created_at"), days=F.lit(version - 1)).alias("ts"),
        )

    yes, no = F.lit(True), F.lit(False)
    created = change(d, 1, "create", F.col("title"), F.col("content"), F.col("folder_id"), (yes, yes, yes), yes)
    patched = change(
        d.filter(i % 4 == 0), 2, "patch", none("string"), F.concat(F.lit("v2: "), F.col("content")), none("int"), (no, yes, i % 8 == 0), none("boolean")
    )
    deleted = change(d.filter(i % 11 == 10), 3, "delete", none("string"), none("string"), none("int"), (no, no, no), no)
    return created.unionByName(patched).unionByName(deleted)


def chunk_vectors_v(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Documents as chunks with vectors; of those in ``only`` (vec_id), if given, so that no other text or vector travels."""
    d, vectors = documents_v(spark, sf_dir), read(spark, sf_dir, "embeddings")
    if only is not None:
        d, vectors = store.of_keys(d, only.select(F.col("vec_id").alias("id")), "id"), store.of_keys(vectors, only, "vec_id")
    return (
        vectors.join(d, F.col("vec_id") == F.col("id"))
        .select("vec_id", F.col("id").alias("doc_id"), F.col("content").alias("page_content"), F.col("title").alias("source"), "embedding", "is_active")
    )
