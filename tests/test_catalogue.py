"""Every catalogue query against its SQL, over the synthetic tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from vellum.operators import models
from vellum.plans import catalogue
from vellum.sources import fixtures, store

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="synthetic tables are not here")


def rows_of(frame):
    return sorted(tuple(map(repr, r)) for r in frame)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    pick = [want.columns.index(c) for c in columns]
    assert rows_of([tuple(r[c] for c in columns) for r in got.collect()]) == rows_of([tuple(r[i] for i in pick) for r in want.fetchall()])


def test_every_query_has_sql_but_the_splitter_and_the_model():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"chunks_markdown", "index_markdown", "chunk_embeddings"}


def brute_split(text, size=1000, overlap=200):
    """Chunks by indices: pieces [i, j) with the largest j that fits; the next i is the first whose tail is short enough."""

    def pieces(part, separators):
        if len(part) <= size:
            return [part] if part else []
        sep = next((s for s in separators if s in part), "")
        if not sep:
            return list(part)
        found = re.split(f"(?={re.escape(sep)})", part)
        return [p for f in found for p in pieces(f, separators[separators.index(sep) + 1 :])]

    cut = pieces(text, ["\n\n", "\n", " "])
    ends = [0]
    for p in cut:
        ends.append(ends[-1] + len(p))
    out, i, j = [], 0, 0
    while j < len(cut):
        j = max(k for k in range(j + 1, len(cut) + 1) if k == j + 1 or ends[k] - ends[i] <= size)
        out.append("".join(cut[i:j]).strip())
        if j < len(cut):
            i = next(k for k in range(i, j + 1) if k == j or (ends[j] - ends[k] <= overlap and ends[j + 1] - ends[k] <= size))
    return [c for c in out if c]


def test_markdown_queries_match_brute_force(spark):
    """The texts have no headers, so a document's chunks are those of its text; each holds what the brute form holds."""
    docs = {r["id"]: r for r in fixtures.documents_v(spark, SF).collect()}
    want = sorted((i, n, c, "{}", r["title"]) for i, r in docs.items() for n, c in enumerate(brute_split(r["content"])))
    got = entry.queries()["chunks_markdown"](spark, SF).collect()
    assert sorted((r["doc_id"], r["chunk_no"], r["page_content"], r["headers"], r["source"]) for r in got) == want
    last = {i: (2, f"v2: {r['content']}") if i % 4 == 0 else (1, r["content"]) for i, r in docs.items() if i % 11 != 10}
    index = entry.queries()["index_markdown"](spark, SF).collect()
    assert sorted((r["doc_id"], r["chunk_no"], r["page_content"], r["version"]) for r in index) == sorted((i, n, c, v) for i, (v, t) in last.items() for n, c in enumerate(brute_split(t)))


def test_embeddings_match_the_model(spark):
    client, chunks = models.StubModel(), entry.queries()["chunks_fixed"](spark, SF).collect()
    want = sorted((r["doc_id"], r["chunk_no"], 64, round(client.embed(r["page_content"])[0], 4)) for r in chunks)
    got = sorted(tuple(r[c] for c in ("doc_id", "chunk_no", "dim", "first")) for r in entry.queries()["chunk_embeddings"](spark, SF).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-4 for g, w in zip(got, want))


def test_list_order(spark):
    rows = [(r["updated_at"], r["id"]) for r in entry.queries()["doc_list"](spark, SF).collect()]
    dated = [r for r in rows if r[0]]
    assert dated == sorted(dated, key=lambda r: (-r[0].timestamp(), r[1]))
    assert rows[len(dated) :] == sorted(r for r in rows if not r[0]) if len(dated) < len(rows) else True


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_texts_are_read_of_the_hits_only(spark):
    hits = spark.createDataFrame([(0, 3), (50, 3), (50, 7)], "query_id long, vec_id long")
    got = fixtures.chunk_vectors_v(spark, SF, hits).collect()
    assert sorted(r["vec_id"] for r in got) == [3, 7]
    assert set(rows_of(got)) <= set(rows_of(fixtures.chunk_vectors_v(spark, SF).collect()))


def test_other_texts_stay_where_they_are(spark):
    """However large Spark takes the hits' table for, texts and vectors are cut down to the hits before they are shuffled."""
    hits = spark.createDataFrame([(0, 3), (50, 3), (50, 7)], "query_id long, vec_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = fixtures.chunk_vectors_v(spark, SF, hits)._jdf.queryExecution().sparkPlan().toString()
        answer = entry.queries()["rag_context"](spark, SF)
        assert answer.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("LeftSemi, BuildRight") == 2 and "SortMergeJoin" in plan and "LeftSemi\n" not in plan


def test_hits_in_blocks(spark):
    rows = spark.createDataFrame([(i % 40, str(i)) for i in range(100)], "id long, content string")
    keys = spark.createDataFrame([(i,) for i in (1, 1, 5, 7, 11, 99, None)], "id long")
    got = store.of_keys(rows, keys, "id", held=2).collect()
    assert sorted(int(r["content"]) for r in got) == [i for i in range(100) if i % 40 in (1, 5, 7, 11)]
