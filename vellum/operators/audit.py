"""Audit rows and request logs."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation and resource names.
OPERATIONS = {
    "document": {"create": "CREATE_DOC", "patch": "UPDATE_DOC", "delete": "DELETE_DOC"},
    "folder": {"create": "CREATE"},
}
RESOURCES = {"document": "DOCUMENT", "folder": "FOLDER"}


def audit_rows(log: DataFrame, kind: str = "document", user: str = "system", details: Column | None = None) -> DataFrame:
    """Audit rows of a change log."""
    names = F.create_map(*[F.lit(x) for pair in OPERATIONS[kind].items() for x in pair])
    return log.select(
        F.lit(user).alias("user_id"),
        F.col("ts").alias("timestamp"),
        names[F.col("op")].alias("action"),
        F.lit(RESOURCES[kind]).alias("resource_type"),
        F.col("id").cast("string").alias("resource_id"),
        (details if details is not None else F.lit(None).cast("string")).alias("details"),
        F.lit("SUCCESS").alias("status"),
    )


def append_quietly(rows: DataFrame, path: str) -> bool:
    """Append audit rows; a failure is logged and told by False, but never stops the work that is audited."""
    try:
        rows.write.mode("append").parquet(path)
        return True
    except Exception:
        logging.getLogger(__name__).exception("audit rows could not be written to %s", path)
        return False


def with_request_ids(requests: DataFrame) -> DataFrame:
    """Requests with an id of their own, a new one each time."""
    return requests.withColumn("request_id", F.uuid())


def logged_requests(requests: DataFrame) -> DataFrame:
    """Requests but for static files and health checks, with their duration in milliseconds."""
    micros = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))
    return requests.filter(~F.col("url").startswith("/static") & (F.col("url") != "/health")).withColumn("duration_ms", micros / F.lit(1000.0))
