"""Handmade cases that the synthetic tables don't hold."""

import datetime as dt
import http.server
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from vellum.functions import dates, text
from vellum.operators import audit, changes, chunking, models, relational, retrieval, temporal
from vellum.sources import schemas, store


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_white_space_is_unicode(spark):
    assert one(spark, text.lstrip(F.col("t")), t="\n　  a b ") == "a b "
    assert one(spark, text.word_count(F.col("t")), t="　one two \n three　") == 3
    assert one(spark, text.word_count(F.col("t")), t=" 　\n") == 0
    assert one(spark, F.length("t"), t="a\U0001f600") == 2


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"choices":[{"text":" \\nhello, world"}]}', "hello"),
        ('{"content":"one。two"}', "one"),
        ('{"choices":[]}', ""),
        ('{"content":", led"}', ""),
        ('{"content":"no end"}', "no end"),
        ('{"content":"full？x"}', "full"),
        ("not json", ""),
    ],
)
def test_replies(spark, raw, want):
    assert one(spark, text.first_phrase(text.reply_text(F.col("r"))), r=raw) == want


@pytest.mark.parametrize(
    ("prefix", "made", "want"), [("abc", "xyz", "xyz"), ("say hel", "hello", "lo"), ("xx abc", "abc", ""), ("", "abc", "abc"), ("abc", "", ""), ("aaa", "aaaa", "a")]
)
def test_overlap(spark, prefix, made, want):
    assert one(spark, text.without_overlap(F.col("m"), F.col("p")), p=prefix, m=made) == want


@pytest.mark.parametrize(
    ("t", "want"), [("# a", True), ("#a", False), ("####### a", False), ("　- a", True), ("> a", True), ("12. a", True), ("```py", True), ("a\n# b", False), ("", False)]
)
def test_markdown_like(spark, t, want):
    assert one(spark, text.markdown_like(F.col("t")), t=t) is want


def test_paste_rule(spark):
    assert one(spark, text.paste_as_markdown(F.col("t"), F.col("h")), t="# abcd", h="") is True
    assert one(spark, text.paste_as_markdown(F.col("t"), F.col("h")), t="# abcd", h="x" * 9) is False
    assert one(spark, text.paste_as_markdown(F.col("t"), F.col("h")), t="# abcd", h="x" * 8) is True


def test_titles_urls_budget(spark):
    assert one(spark, text.normal_title(F.col("t")), t=" UNTITLED document ") == ""
    assert one(spark, text.normal_title(F.col("t")), t="Plan") == "Plan"
    assert one(spark, text.completion_url(F.col("u"), "http://local/v1/completions"), u="http://a/v1//") == "http://a/v1/completions"
    assert one(spark, text.completion_url(F.col("u"), "http://local/v1/completions"), u="") == "http://local/v1/completions"
    assert one(spark, text.completion_budget(F.col("p")), p="python") == 64
    assert one(spark, text.completion_budget(F.col("p")), p="```sql\n```python\nx") == 128
    assert one(spark, text.at_end(F.col("t"), F.lit(1)), t="a　\n") is True


def test_dates(spark):
    shown = lambda t: one(spark, dates.local_text(dates.parsed_utc(F.col("t")), "Asia/Shanghai"), t=t)
    assert shown("2024-03-01T20:00:00") == shown("2024-03-01 20:00:00") == shown("2024-03-01T20:00:00Z") == "2024-03-02 04:00:00"
    assert shown("2024-03-01T20:00:00-05:00") == "2024-03-02 09:00:00"
    assert one(spark, dates.local_text(F.col("t").cast("timestamp_ntz"), "UTC"), t=None) == ""


def test_header_sections():
    md = "intro\n# A\ntext\n## B\nmore\n```\n# not a header\n```\n#### deep\n#x\n# C\n"
    assert chunking.header_sections(md) == [
        ("intro", {}),
        ("text", {"Header 1": "A"}),
        ("more\n```\n# not a header\n```\n#### deep\n#x", {"Header 1": "A", "Header 2": "B"}),
    ]
    assert chunking.header_sections("# only\n## headers") == []
    assert [c for c, _ in chunking.markdown_chunks("# only\n## headers")] == ["# only\n## headers"]
    assert chunking.markdown_chunks("") == chunking.markdown_chunks(" \n ") == []


@pytest.mark.parametrize(("n", "sizes"), [(999, [999]), (1000, [1000]), (1001, [1000, 201]), (1800, [1000, 1000]), (1801, [1000, 1000, 201])])
def test_unbroken_text(n, sizes):
    body = "".join(chr(97 + i % 26) for i in range(n))
    chunks = chunking.split_text(body)
    assert [len(c) for c in chunks] == sizes
    assert chunks[0] + "".join(c[200:] for c in chunks[1:]) == body


def test_chunks_keep_every_word_in_order():
    body = "\n\n".join(" ".join(f"w{p}x{i}" for i in range(40 + 90 * (p % 3))) for p in range(12))
    chunks = chunking.split_text(body)
    assert all(0 < len(c) <= 1000 for c in chunks)
    at = 0
    for c in chunks:
        found = body.index(c.split()[0])
        assert found <= at + 2
        at = found + len(c)
    assert set(" ".join(chunks).split()) == set(body.split())


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "T", "# A\nx"), (2, "U", ""), (3, "V", None), (4, None, "y")], "id int, title string, content string")
    got = sorted((r["doc_id"], r["chunk_no"], r["page_content"], r["headers"], r["source"]) for r in chunking.chunk_documents(docs).collect())
    assert got == [(1, 0, "x", {"Header 1": "A"}, "T"), (4, 0, "y", {}, None)]


T0 = dt.datetime(2024, 1, 1)


def test_patches(spark):
    docs = spark.createDataFrame(
        [(1, "a", "x", 5, True, None), (2, "b", "y", 6, True, None), (3, "c", "z", 7, False, None)],
        "id long, title string, content string, folder_id int, is_active boolean, updated_at timestamp_ntz",
    )
    patches = spark.createDataFrame(
        [(1, None, None, None, False, False, True, T0), (2, "b", None, None, True, False, False, T0), (9, "q", None, None, True, False, False, T0)],
        "id long, title string, content string, folder_id int, title_set boolean, content_set boolean, folder_id_set boolean, ts timestamp_ntz",
    )
    got = {r["id"]: (r["title"], r["content"], r["folder_id"], r["updated_at"]) for r in changes.apply_patches(docs, patches).collect()}
    assert got == {1: ("a", "x", None, T0), 2: ("b", "y", 6, T0), 3: ("c", "z", 7, None)}
    gone = {r["id"]: (r["is_active"], r["updated_at"]) for r in changes.soft_delete(docs, docs.filter("id > 1"), F.lit(T0).cast("timestamp_ntz")).collect()}
    assert gone == {1: (True, None), 2: (False, T0), 3: (False, None)}


def edits(spark, seconds, composing=()):
    rows = [(1, T0 + dt.timedelta(seconds=s), i, f"c{i}", i in composing) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "doc_id long, ts timestamp_ntz, edit_id long, content string, is_composing boolean")


def test_debounce_gaps(spark):
    saves = temporal.debounced(edits(spark, [0, 1, 3, 5.5, 5.5, 9], composing=(5,)))
    assert sorted((r["content"], r["n_edits"]) for r in saves.collect()) == [("c2", 3), ("c4", 2)]
    for bucket in ("second", "minute", "day"):
        rows = edits(spark, [0, 1, 3, 5.5, 5.5, 9, 60, 61, 63.5, 200], composing=(5,))
        both = [sorted((r["first_ts"], r["last_ts"], r["content"], r["n_edits"]) for r in d.collect()) for d in (temporal.debounced(rows), temporal.debounced_wide(rows, 2, bucket=bucket))]
        assert both[0] == both[1]


def test_save_states(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    saves = spark.createDataFrame([(1, at(10), at(12), True), (1, at(40), at(45), False)], "doc_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, ok boolean")
    rows = edits(spark, [0, 5, 30])
    for now, want in ((3, "unsaved"), (10, "saving"), (12, "saved"), (31, "unsaved"), (41, "saving"), (45, "error"), (99, "error")):
        assert [r["status"] for r in temporal.save_status(rows, saves, F.lit(at(now))).collect()] == [want], now


OPS = [
    (0, "k", "get", 0, None, None),
    (1, "k", "put", 10, 1.0, 60),
    (2, "k", "get", 70, None, None),
    (3, "k", "get", 71, None, None),
    (4, "k", "put", 80, 2.0, 60),
    (5, "k", "put", 81, 3.0, None),
    (6, "k", "get", 200_000, None, None),
    (7, "j", "get", 90, None, None),
    (8, "k", "put", 200_001, 4.0, 60),
    (9, "k", "get", 400_000, None, None),
    (10, "d", "put", 10, 5.0, None),
    (11, "d", "get", 90_000, None, None),
    (12, "d", "delete", 90_001, None, None),
    (13, "d", "get", 90_002, None, None),
    (14, "d", "get", 190_002, None, None),
    (15, "d", "put", 190_003, 6.0, 5),
    (16, "d", "get", 190_004, None, None),
]
SEEN = [(0, False, None), (2, True, 1.0), (3, False, None), (6, True, 3.0), (7, False, None), (9, False, None)]
SEEN += [(11, True, 5.0), (13, False, None), (14, False, None), (16, True, 6.0)]
OP_TYPE = "op_id long, key string, op string, ts timestamp_ntz, value double, ttl_s int"


def ops(spark):
    return spark.createDataFrame([(i, k, o, T0 + dt.timedelta(seconds=s), v, t) for i, k, o, s, v, t in OPS], OP_TYPE)


def test_ttl(spark):
    assert sorted((r["op_id"], r["hit"], r["value"]) for r in temporal.ttl_reads(ops(spark)).collect()) == SEEN


def test_nearest_and_sources(spark):
    rows = [(0, [0.0, 0.0], "same", "q"), (1, [0.0, 1.0], "same", "a" * 120), (2, [0.0, -1.0], "same", "b"), (3, [2.0, 0.0], None, "c"), (4, [9.0, 0.0], "far", "d")]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, source string, page_content string")
    hits = retrieval.nearest(corpus.filter("vec_id = 0"), corpus)
    assert [(r["vec_id"], r["dist"], r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1.0, 1), (2, 1.0, 2), (3, 4.0, 3)]
    got = retrieval.contexts(hits).first()
    assert got["context"] == "a" * 120 + "\n\nb\n\nc"
    assert [(s["title"], s["content"]) for s in got["sources"]] == [("same", "a" * 100 + "..."), ("Unknown", "c...")]
    assert retrieval.nearest(corpus.limit(0), corpus).collect() == []


def test_model_boundary(spark):
    calls = []

    def flaky(value):
        calls.append(value)
        if len(calls) < 3:
            raise OSError
        return value

    waits = []
    assert models.retried(flaky, "v", sleep=waits.append) == "v" and waits == [2.0, 4.0]
    cursors = spark.createDataFrame([(1, "abc", "x"), (2, "", "y"), (3, None, "z")], "id long, prefix string, suffix string")
    got = {r["id"]: r["completion"] for r in models.completions(cursors, models.StubModel()).collect()}
    assert got[2] == got[3] == "" and got[1].startswith("stub ")
    vectors = models.with_embeddings(spark.createDataFrame([("a",), (None,)], "page_content string"), models.StubModel()).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in vectors)


class Failing(models.StubModel):
    def complete(self, prompt):
        raise OSError


def test_failed_completions_are_empty(spark):
    cursors = spark.createDataFrame([(1, "abc", "x")], "id long, prefix string, suffix string")
    got = models.completions(cursors, Failing(), waits=()).collect()
    assert [(r["completion"], r["status"]) for r in got] == [("", "error")]
    asked = cursors.withColumn("prompt", F.col("prefix"))
    assert [r["reply"] for r in models.with_replies(asked, Failing(), waits=()).collect()] == [models.APOLOGY]


def test_answers_go_through_the_cache(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    at = lambda s: T0 - dt.timedelta(seconds=s)
    asked = spark.createDataFrame([(1, "a", "pa"), (2, "b", "pb"), (3, "c", "pc"), (4, "c", "pc"), (5, "d", "pd"), (6, "e", "pe")], "id long, cache_key string, prompt string")
    rows = [("a", "put", at(3600), "old a", 3600), ("b", "put", at(3601), "old b", 3600), ("d", "put", at(9), "old d", None), ("e", "put", at(9), "old e", 99), ("e", "delete", at(8), None, None)]
    cache = spark.createDataFrame(rows, "key string, op string, ts timestamp_ntz, value string, ttl_s int")
    answers, puts = models.cached_answers(asked, cache, models.StubModel(), now)
    stub = models.StubModel().complete
    want = [(1, "old a", "cached"), (2, stub("pb"), "ok"), (3, stub("pc"), "ok"), (4, stub("pc"), "ok"), (5, "old d", "cached"), (6, stub("pe"), "ok")]
    assert answers.columns == [*asked.columns, "reply", "status"] and sorted((r["id"], r["reply"], r["status"]) for r in answers.collect()) == want
    assert sorted((r["key"], r["value"], r["ttl_s"]) for r in puts.collect()) == [("b", stub("pb"), 3600), ("c", stub("pc"), 3600), ("e", stub("pe"), 3600)]


def test_completion_server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            reply = {"/v1/embeddings": {"data": [{"embedding": [1.0, 2.0]}]}}.get(self.path) or {"p1": {"choices": [{"text": "one"}]}, "p2": {"choices": [], "content": "two"}}.get(body["prompt"], {})
            raw = json.dumps(reply).encode()
            self.send_response(500 if body.get("prompt") == "bad" else 200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = models.HttpModel(f"http://127.0.0.1:{server.server_port}/v1//", "m", stop=("x",))
    assert [client.complete(p) for p in ("p1", "p2", "p3")] == ["one", "two", ""] and client.embed("t") == [1.0, 2.0]
    assert seen[0] == ("/v1/completions", {"model": "m", "max_tokens": 24, "temperature": 0.1, "stop": ["x"], "stream": False, "prompt": "p1"})
    with pytest.raises(OSError):
        client.complete("bad")
    server.shutdown()
    server.server_close()
    with pytest.raises(OSError):
        client.complete("p1")


def test_queries_in_blocks(spark):
    rows = [(i, [float(i * 37 % 101), float(i % 7)]) for i in range(80)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, i, r + 1) for q, v in rows for r, (_, i) in enumerate(sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2, i) for i, w in rows if i != q)[:3])}
    for block in (1000, 7):
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.nearest(corpus, corpus, block=block).collect()} == want


def test_lookups(spark):
    folders = spark.createDataFrame([(1, "r", None, True), (2, "s", 1, False)], "id int, title string, parent_id int, is_active boolean")
    assert relational.one_or_none(relational.folder_by_id(folders, 2))["title"] == "s"
    assert relational.one_or_none(relational.folder_by_id(folders, 9)) is None
    with pytest.raises(ValueError):
        relational.one_or_none(folders)
    assert [r["id"] for r in relational.child_folders(folders, 0).collect()] == [1]
    assert relational.answerable(spark.createDataFrame([("　 ",), ("a",)], "text string")).count() == 1


def test_store(spark, tmp_path):
    uri = store.storage_uri("sqlite", str(tmp_path))
    assert uri == str(tmp_path) and store.storage_uri("db", "", database="w") == "jdbc:postgresql://db:5432/w"
    assert store.open_vectors(spark, uri).columns == schemas.CHUNK_VECTORS.names
    store.create_tables(spark, uri, {"folders": schemas.FOLDERS})
    assert store.open_table(spark, uri, "folders", schemas.FOLDERS).count() == 0
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, page_content string")
    store.append_chunks(chunks, f"{uri}/chunks")
    store.append_chunks(chunks, f"{uri}/chunks")
    kept = store.without_documents(spark.read.parquet(f"{uri}/chunks"), spark.createDataFrame([(1,)], "doc_id long"))
    assert [r["doc_id"] for r in kept.collect()] == [2, 2]


def test_logs(spark, tmp_path):
    rows = [(T0 + dt.timedelta(days=d), level, f"{d} {level}") for d in range(12) for level in ("DEBUG", "INFO", "ERROR")]
    logs = spark.createDataFrame(rows, "ts timestamp_ntz, level string, text string")
    assert store.at_least(logs, "INFO").count() == 24
    store.append_logs(logs, f"{tmp_path}/logs", "INFO")
    held = store.retained(spark.read.parquet(f"{tmp_path}/logs"), F.lit(T0 + dt.timedelta(days=11)))
    assert held.count() == 22 and "PartitionFilters: [isnotnull(day" in held._jdf.queryExecution().executedPlan().toString()


def test_audit_never_stops_the_work(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    (tmp_path / "file").write_text("in the way")
    assert audit.append_quietly(rows, f"{tmp_path}/rows") and not audit.append_quietly(rows, f"{tmp_path}/file/rows")
    assert audit.with_request_ids(spark.range(50)).select("request_id").distinct().count() == 50


def test_requests(spark):
    rows = [(1, T0, T0 + dt.timedelta(milliseconds=1.5), "/documents/1"), (2, T0, T0, "/static/a"), (3, T0, T0, "/health"), (4, T0, T0, "/healthy")]
    got = audit.logged_requests(spark.createDataFrame(rows, "id long, start_ts timestamp_ntz, end_ts timestamp_ntz, url string")).collect()
    assert [(r["id"], r["duration_ms"]) for r in got] == [(1, 1.5), (4, 0.0)]


def test_nearest_of_odd_vectors(spark):
    """Places without a value in either vector don't count, as in the SQL; no place at all comes last, after what is no number."""
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [4.0]), (4, [nan, 2.0]), (5, []), (6, [float("inf"), 0.0]), (7, [1.0, 2.5, 9.0]), (8, [1e200, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.nearest(corpus.filter("vec_id = 0"), corpus, k=9).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 7, 3, 6, 8, 4, 1, 5]
    assert [r["dist"] for r in got[:4]] == [0.0, 0.25, 9.0, float("inf")] and [r["dist"] for r in got[6:]] == [None, None]
    none = retrieval.nearest(corpus.filter("vec_id = 1"), corpus)
    assert [r["vec_id"] for r in none.orderBy("rank").collect()] == [0, 2, 3]


def test_nearest_ranks_repeated_keys_row_by_row(spark):
    rows = [(0, [0.0], "q"), (1, [3.0], "far"), (1, [1.0], "near"), (2, [2.0], "b"), (3, [2.5], "c")]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>, page_content string")
    got = retrieval.nearest(corpus.filter("vec_id = 0"), corpus).orderBy("rank").collect()
    assert [r["page_content"] for r in got] == ["near", "b", "c"]


def test_nearest_in_passes_and_among_copies(spark):
    rows = [(i, [float(i // 40), 1e6]) for i in range(200)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = {(q, i) for q, v in rows for _, i in sorted(((v[0] - w[0]) ** 2, i) for i, w in rows if i != q)[:3]}
    got = retrieval.nearest_keys(corpus, corpus, block=7, size=1000)
    assert {tuple(r) for r in got.collect()} == want


def test_search_carries_no_texts(spark):
    """Neither pairs nor shuffles hold the texts: the search reads keys and vectors alone."""
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.raise_error(F.lit("read")).cast("string").alias("page_content"))
    got = retrieval.nearest_keys(rows.filter("vec_id % 50 = 0"), rows)
    assert got.columns == ["query_id", "vec_id"] and got.count() == 24


def test_overlap_against_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        made, prefix = ("".join(rng.choices("ab\U0001f600", (9, 1, 1), k=rng.randrange(60))) for _ in range(2))
        want = max((n for n in range(min(len(made), len(prefix)) + 1) if prefix.endswith(made[:n])), default=0)
        assert text.overlap(made, prefix) == want


def test_overlap_of_long_repetitive_texts(spark):
    """Time is in proportion to the length, where comparing every size took its square."""
    rows = [("a" * 400_000 + "b", "a" * 400_000, "b"), ("ab" * 200_000, "c" + "ab" * 150_000 + "a", "b" + "ab" * 49_999), ("x", None, "x"), (None, "x", None)]
    frame = spark.createDataFrame([(m, p) for m, p, _ in rows], "m string, p string")
    began = time.monotonic()
    got = [r["x"] for r in frame.select(text.without_overlap(F.col("m"), F.col("p")).alias("x")).collect()]
    # The second prefix ends with "a", whose longest common head is all of its "ab"s and that "a".
    assert got == [rows[0][2], ("ab" * 200_000)[300_001:], "x", None]
    assert time.monotonic() - began < 60
