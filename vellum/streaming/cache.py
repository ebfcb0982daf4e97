"""A cache with time-to-live over a stream of reads, writes and deletions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A value's state goes this long after its time to live; a value without one stays for good.
KEPT_MS = 24 * 3600 * 1000
OUT = "op_id long, key string, hit boolean, value double"
STATE = "ts double, value double, ttl_s double"


def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State per key: the last write. A read sees it until its time to live is over or it is deleted.

    The operations of one key in one trigger are ordered in memory; a source that limits its
    files or offsets a trigger bounds them.
    """
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    out = []
    for op in pd.concat(list(batches)).sort_values(["ts", "op_id"]).itertuples():
        at = op.ts.timestamp()
        if op.op == "put":
            held = (at, float(op.value), float("inf") if pd.isna(op.ttl_s) else float(op.ttl_s))
        elif op.op == "delete":
            held = None
        else:
            hit = held is not None and at <= held[0] + held[2]
            out.append((op.op_id, key[0], hit, held[1] if hit else None))
    if held is not None:
        state.update(tuple(held))
        if held[2] != float("inf"):
            state.setTimeoutDuration(KEPT_MS + int(held[2] * 1000))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["op_id", "key", "hit", "value"]).astype({"value": "float64", "hit": "bool"})


def stream_reads(ops: DataFrame) -> DataFrame:
    """What every read of a stream of cache operations sees."""
    return ops.groupBy("key").applyInPandasWithState(serve, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
