"""Debounce, time-to-live and latest-wins over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def debounced(edits: DataFrame, gap: str = "2 seconds", key: str = "doc_id", order: str = "edit_id") -> DataFrame:
    """One save per burst of edits: the last content. Edits while composing don't count.

    A burst ends where the quiet is longer than the gap. Works on streams as well.
    """
    return (
        edits.filter(~F.col("is_composing"))
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.max_by("content", F.struct("ts", order)).alias("content"), F.max("ts").alias("last_ts"), F.count("*").alias("n_edits"))
        .select(key, F.col("w.start").alias("first_ts"), "last_ts", "content", "n_edits")
    )


def debounced_wide(edits: DataFrame, gap_s: float, key: str = "doc_id", order: str = "edit_id", bucket: str = "day") -> DataFrame:
    """The same saves for batches in which one key may hold much of the table.

    Each edit is numbered by the bursts before it, in two levels: within a time bucket of
    its key by a window, and over buckets by their counts and last times. So no task holds
    more than one bucket of a key, and bursts are then grouped by key and number.
    """
    rows = edits.filter(~F.col("is_composing")).withColumn("_b", F.date_trunc(bucket, F.col("ts")))
    inside = Window.partitionBy(key, "_b").orderBy("ts", order)
    quiet = lambda a, b: F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp")) > int(gap_s * 1_000_000)
    marked = rows.withColumn("_prev", F.lag("ts").over(inside)).withColumn("_fresh", F.coalesce(quiet(F.col("_prev"), F.col("ts")), F.lit(False)).cast("long"))
    marked = marked.withColumn("_n", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(key, "_b").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"), F.sum("_fresh").alias("_inner"))
    over = Window.partitionBy(key).orderBy("_b")
    edge = ends.withColumn("_open", F.coalesce(quiet(F.lag("_hi").over(over), F.col("_lo")), F.lit(False)).cast("long"))
    base = edge.select(
        F.col(key).alias("_key"),
        F.col("_b").alias("_bucket"),
        (F.sum(F.col("_inner") + F.col("_open")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner")).alias("_base"),
    )
    numbered = marked.join(base, F.col(key).eqNullSafe(F.col("_key")) & F.col("_b").eqNullSafe(F.col("_bucket")))
    return (
        numbered.groupBy(key, (F.col("_n") + F.col("_base")).alias("_burst"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("content", F.struct("ts", order)).alias("content"), F.count("*").alias("n_edits"))
        .drop("_burst")
    )


def save_status(edits: DataFrame, saves: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """The state of each edited document at ``now``.

    ``saves`` has begin, end and outcome (start_ts, end_ts, ok) of every save. A document is
    unsaved if an edit came after its last save began, else saving until that has ended,
    then saved or, if it failed, error.
    """
    last_edit = edits.filter(F.col("ts") <= now).groupBy(key).agg(F.max("ts").alias("edit_ts"))
    begun = saves.filter(F.col("start_ts") <= now).groupBy(key).agg(F.max(F.struct("start_ts", "end_ts", "ok")).alias("last"))
    state = (
        F.when(F.col("last").isNull() | (F.col("edit_ts") > F.col("last.start_ts")), "unsaved")
        .when(now < F.col("last.end_ts"), "saving")
        .when(F.col("last.ok"), "saved")
        .otherwise("error")
    )
    return last_edit.join(begun, key, "left").withColumn("status", state)


def latest_per_key(requests: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The request that supersedes all earlier ones of its key."""
    return requests.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def invalidations(log: DataFrame, key: str = "documents_list") -> DataFrame:
    """Cache operations of a change log: every write to documents deletes their cached list.

    Operations of changes are numbered below zero, so that reads of the same time come after.
    """
    return log.select(
        (-(F.col("id") * 10 + F.col("version"))).cast("long").alias("op_id"), F.lit(key).alias("key"), F.lit("delete").alias("op"), "ts", F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("ttl_s")
    )


def ttl_reads(ops: DataFrame, bucket: str = "day") -> DataFrame:
    """What each read sees: the key's last write before it, unless that has expired or is a deletion.

    An as-of match in two levels: inside a key's time bucket by a window, and from one
    bucket to the next by the buckets' last writes, so a hot key spreads over tasks.
    """
    write = F.when(F.col("op").isin("put", "delete"), F.struct("ts", "op_id", "value", "ttl_s", "op"))
    cut = ops.withColumn("_b", F.date_trunc(bucket, F.col("ts")))
    inside = Window.partitionBy("key", "_b").orderBy("ts", "op_id").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", F.last(write, ignorenulls=True).over(inside))
    ends = cut.groupBy("key", "_b").agg(F.max(write).alias("_end"))
    before = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("key").alias("_key"), F.col("_b").alias("_bucket"), F.last("_end", ignorenulls=True).over(before).alias("_far"))
    reads = near.filter("op = 'get'").join(carried, (F.col("key") == F.col("_key")) & (F.col("_b") == F.col("_bucket")))
    seen = F.coalesce("_near", "_far")
    alive = seen.isNotNull() & (seen["op"] == "put") & (seen["ttl_s"].isNull() | (F.col("ts") <= seen["ts"] + F.make_dt_interval(secs=seen["ttl_s"].cast("decimal(18,6)"))))
    return reads.select("op_id", "key", "ts", F.coalesce(alive, F.lit(False)).alias("hit"), F.when(alive, seen["value"]).alias("value"))
