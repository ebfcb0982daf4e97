"""Plans keep filters and column lists at the scan, and Python out of native queries."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="synthetic tables are not here")
PYTHON = {"chunks_markdown", "polish_text", "extend_text", "complete_text", "ask_plain", "rag_answer", "rag_cache_fill", "index_markdown", "chunk_embeddings"}


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_lookup_reaches_the_scan(spark):
    text = plan(spark, "doc_get")
    assert "EqualTo(doc_id,7)" in text and "lang" not in text.split("ReadSchema")[1]


def test_scans_read_what_is_used(spark):
    shown = plan(spark, "latest_requests").split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(shown.split(",")) == ["event_id:bigint", "event_type:string", "user_id:bigint"]
    assert "text" not in plan(spark, "doc_newest").split("ReadSchema")[1]


@pytest.mark.parametrize("name", sorted(n for n in entry.catalogue.QUERIES if n not in PYTHON))
def test_native_queries_run_no_python(spark, name):
    text = plan(spark, name)
    assert not any(k in text for k in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"))
