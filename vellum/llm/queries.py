"""Queries over the synthetic tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lm, packing, secrets, sharding, simhash, topk, toxicity, warc
from .common import text_fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaks into it."""
    found = decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), "words", "equal", "similarity")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(text_fold("doc_id", 4) != 2))
    return langid.identify(docs, model).select(
        F.col("id").alias("doc_id"), (text_fold("id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document, learned from six of seven folds."""
    docs = _read(spark, sf_dir, "documents")
    model, counts = lm.learn(docs.filter(text_fold("doc_id", 7) != 2))
    return lm.score_documents(docs, model, counts).select(
        F.col("id").alias("doc_id"),
        (text_fold("id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards under the ``rows`` law."""
    placed = sharding.interleave_shards(_read(spark, sf_dir, "documents"), n_shards=40)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives, as read back."""
    return warc.convert_pages(_read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five folds."""
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(text_fold("doc_id", 5) != 0))
    return toxicity.score_documents(docs, model).select(
        F.col("id").alias("doc_id"),
        (text_fold("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every hundredth vector."""
    table = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k_search(table, table.filter(F.col("vec_id") % 100 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_langid": op2_langid,
    "op3_lm": op3_lm,
    "op4_interleave": op4_interleave,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
}

ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages
        )
        SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
        FROM p
    """,
    "op10_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.e, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s
        ) WHERE rank <= 10
    """,
}
