"""Proportional stratified interleaving into shards.

Rows of each source are put in a seeded random order and given the fractional rank
(rank - 1/2) / size of the source. Sorted by that, any stretch of the order holds the
sources in their overall proportions, so cutting it evenly gives shards that all match
the mixture.

Defined cases: a null source is a source of its own; a null text has size 16 and the
checksum of the empty string; repeated rows take a slot each; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, pinned, with_ordinal

SEED = 20240229
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, text_crc32, shard, slot, frac."""
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    base = pinned(
        docs.select(
            docs[id_col].alias("id"),
            docs[source_col].alias("source"),
            (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(F.lit(seed), docs[id_col]).alias("_key"),
        ).withColumn("_none", F.col("source").isNull())
    )
    ranked = with_ordinal(base, ["_none", "source", "_key", "id"], "_at", ["text_crc32", "size"])
    ranked = pinned(ranked)
    sources = lookup(
        ranked.groupBy(F.col("_none").alias("_n"), F.col("source").alias("_s")).agg(
            F.count("*").alias("_rows"), F.min("_at").alias("_start")
        )
    )
    placed = ranked.join(sources, (F.col("_none") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        "id", "source", "size", "text_crc32", "_at", ((F.col("_at") - F.col("_start") + F.lit(0.5)) / F.col("_rows")).alias("frac")
    )
    ordered = with_ordinal(placed, ["frac", "_at"], "_pos")
    total = base.count()
    shard = F.expr(f"_pos * {n_shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return (
        ordered.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_pos") - start.cast("long"))
        .select("id", "source", "size", "text_crc32", "shard", "slot", "frac")
    )
