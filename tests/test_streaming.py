"""Streams against their batch forms."""

import pandas as pd
from pyspark.sql.streaming.state import GroupStateTimeout

from tests.test_engine import SEEN, T0, edits, ops
from vellum.operators import temporal
from vellum.streaming import cache, debounce, indexing


def stream_of(spark, frame, path):
    frame.write.parquet(str(path))
    return spark.readStream.schema(frame.schema).parquet(str(path))


def test_debounce(spark, tmp_path):
    rows = edits(spark, [0, 1, 3, 5.5, 9, 12])
    saves = debounce.stream_saves(stream_of(spark, rows, tmp_path / "in"))
    saves.writeStream.format("memory").queryName("saves").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((r["content"], r["n_edits"]) for r in spark.table("saves").collect())
    assert got == sorted((r["content"], r["n_edits"]) for r in temporal.debounced(rows).collect())


def test_cache(spark, tmp_path):
    reads = cache.stream_reads(stream_of(spark, ops(spark), tmp_path / "in"))
    reads.writeStream.format("memory").queryName("reads").outputMode("append").trigger(availableNow=True).start().awaitTermination(40)
    assert sorted((r["op_id"], r["hit"], r["value"]) for r in spark.table("reads").fillna(-1.0).collect()) == [(i, h, -1.0 if v is None else v) for i, h, v in SEEN]


class State:
    """What serve() uses of a group's state."""

    hasTimedOut, exists, timeout = False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_only_values_with_a_time_to_live_time_out():
    row = lambda i, op, ttl=None: {"op_id": i, "op": op, "ts": pd.Timestamp(T0), "value": 1.0, "ttl_s": ttl}
    state = State()
    list(cache.serve(("k",), iter([pd.DataFrame([row(1, "put")])]), state))
    assert state.exists and state.timeout is None
    list(cache.serve(("k",), iter([pd.DataFrame([row(2, "put", 60.0)])]), state))
    assert state.timeout == cache.KEPT_MS + 60_000
    got = pd.concat(cache.serve(("k",), iter([pd.DataFrame([row(3, "get"), row(4, "delete"), row(5, "get")])]), state))
    assert got["hit"].tolist() == [True, False] and not state.exists and GroupStateTimeout.ProcessingTimeTimeout


def test_index_and_audit(spark, tmp_path):
    log = spark.createDataFrame(
        [(1, 1, "create", "a", "# H\ntext", True, T0), (1, 2, "patch", "a", None, False, T0), (2, 1, "create", "b", "more", True, T0), (2, 2, "patch", "b", "new", True, T0)]
        + [(3, 1, "create", "c", "gone", True, T0), (3, 2, "delete", None, None, False, T0), (4, 1, "delete", None, None, False, T0), (4, 2, "create", "d", "back", True, T0)],
        "id long, version int, op string, title string, content string, content_set boolean, ts timestamp_ntz",
    )
    paths = [str(tmp_path / n) for n in ("chunks", "gone", "audit")]
    source = stream_of(spark, log, tmp_path / "log")
    for run in range(2):
        # A checkpoint that is lost makes the batch run again.
        indexing.follow_changes(source, *paths, str(tmp_path / f"ck{run}")).awaitTermination(60)
        assert sorted((r["doc_id"], r["page_content"], r["version"]) for r in spark.read.parquet(paths[0]).collect()) == [(1, "text", 1), (2, "more", 1), (2, "new", 2), (3, "gone", 1), (4, "back", 2)]
        kept = indexing.current_index(spark, *paths[:2]).collect()
        assert sorted((r["doc_id"], r["page_content"], r["version"]) for r in kept) == [(1, "text", 1), (2, "new", 2), (4, "back", 2)]
        assert sorted(r["action"] for r in spark.read.parquet(paths[2]).collect()) == ["CREATE_DOC"] * 4 + ["DELETE_DOC"] * 2 + ["UPDATE_DOC"] * 2
