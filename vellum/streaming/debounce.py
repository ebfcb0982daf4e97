"""Debounced saves over a stream of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import debounced


def stream_saves(edits: DataFrame, gap: str = "2 seconds", lateness: str = "1 hour", key: str = "doc_id") -> DataFrame:
    """As the batch operator; a burst is final once the watermark has passed it.

    Watermarks need zoned timestamps, so times are read as UTC of the session.
    """
    return debounced(edits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), gap, key)
