import zlib
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm import sharding
from vellum.llm.queries import op4_interleave


def test_shards_are_even_gapless_and_mixed(spark):
    rows = [(i, f"text {i % 7}" if i % 11 else None, "big" if i % 3 else f"s{i % 5}" if i % 4 else None) for i in range(1003)] + [(5, "again", "big")] * 2
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, shard int, frac int")
    got = sharding.interleave_shards(docs, n_shards=8).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    share = Counter(s for _, _, s in rows)
    for s in range(8):
        here = Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(here[k] - n / 8) <= 2 for k, n in share.items())
    for r in got:
        raw = next(t for i, t, _ in rows if i == r["id"]) if r["id"] != 5 else None
        if r["id"] != 5:
            assert r["text_crc32"] == zlib.crc32((raw or "").encode()) and r["size"] == len((raw or "").encode()) + 16


def test_order_matches_brute_force(spark):
    rows = [(i, f"t{i}", "ab"[i % 3 == 0]) for i in range(40)]
    got = sharding.interleave_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_shards=3).collect()
    placed = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["frac"] for r in placed] == sorted(r["frac"] for r in got)
    for s in "ab":
        n = sum(r["source"] == s for r in got)
        assert sorted(r["frac"] for r in got if r["source"] == s) == [(k + 0.5) / n for k in range(n)]


def test_query_matches_brute_force(spark, tmp_path):
    """Shard, slot and order of every row, with nulls, ties, repeated rows and a very long text."""
    rows = [(i, f"t{i % 5}" if i % 9 else None, ["a", "b", None][i % 3]) for i in range(95)] + [(3, "t3", "a")] * 2 + [(None, "n", "b"), (400, "long " * 300_000, "c")]
    table = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    keys = {r["doc_id"]: r["k"] for r in table.select("doc_id", F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("k")).collect()}
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 16
    line = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", keys[r[0]], r[0] is not None, r[0] or 0, crc(r[1]), size(r[1])))
    many, rank, order = Counter(r[2] for r in rows), Counter(), []
    for at, r in enumerate(line):
        order.append(((rank[r[2]] + 0.5) / many[r[2]], at, r))
        rank[r[2]] += 1
    n, used, want = len(rows), Counter(), []
    for pos, (_, _, r) in enumerate(sorted(order, key=lambda x: x[:2])):
        shard = pos * 40 // n
        want.append((r[0], size(r[1]), crc(r[1]), "rows", shard, used[shard], None))
        used[shard] += 1
    got = [tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")) for r in op4_interleave(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_and_one_row(spark):
    docs = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    assert [(r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in sharding.interleave_shards(docs).collect()] == [(0, 0, 16, 0)]
    assert sharding.interleave_shards(docs.limit(0)).collect() == []
