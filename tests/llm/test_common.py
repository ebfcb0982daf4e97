import numpy as np
import pyarrow as pa

from vellum.llm import common


def test_slices_are_bounded_and_whole():
    texts = ["a" * n for n in (0, 3, 10, 50, 1, 1, 1)] + [None, "éé"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"])
    for rows, size in ((100, 12), (2, 1000), (100, 1), (100, 10**9)):
        parts = list(common.slices(iter([batch, batch.slice(0, 0)]), rows, size))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        for p in parts:
            total = sum(len((t or "").encode()) for t in p.column(1).to_pylist())
            assert p.num_rows <= rows and (total <= size or p.num_rows == 1)


def test_word_counts():
    texts = [None, "", " ", "a", " a  b\x0bc\x0c", "é ü", "x" * 1000, "　"]
    assert common.word_counts(pa.array(texts)).tolist() == [len((t or "").encode().split()) for t in texts]
    assert common.word_counts(pa.array(texts).slice(3, 2)).tolist() == [1, 3]
    assert common.word_counts(pa.array([], pa.string())).tolist() == []


def test_ordinals(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(500)], "k int, t int")
    got = common.with_ordinal(rows, ["k"], "n", ["t"]).collect()
    assert sorted(r["n"] for r in got) == list(range(500))
    by = sorted(got, key=lambda r: r["n"])
    assert [(r["k"], r["t"]) for r in by] == sorted((r["k"], r["t"]) for r in got)


def test_least_count(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [5] * 5 + [20_000] * 3 + [90_000]], "n long")
    for rows, least in ((200, 1), (29, 2), (28, 5), (9, 5), (8, 10_000), (4, 10_000), (3, 40_000), (0, 160_000)):
        assert common.least_count(counts, "n", rows) == least
    assert np.int64(common.least_count(counts.limit(0), "n", 5)) == 10_000


def test_bounded_sample(spark):
    """Bounds of rows and bytes hold with repeated ids, null ids and one very long text."""
    rows = [(i, "x" * 10, i % 2) for i in range(400)] + [(None, f"t{i}", 0) for i in range(200)] + [(7, "again", 1)] * 300 + [(1000, "y" * 5000, 1)]
    table = spark.createDataFrame(rows, "id long, text string, k int")
    for most, size in ((50, 10**6), (1000, 400), (20, 10**6)):
        got = common.bounded_sample(table, ["id", "text"], most, size, 5, text="text", by="k").collect()
        for k in (0, 1):
            mine = [r for r in got if r["k"] == k]
            assert 0 < len(mine) <= most and sum(len(r["text"]) for r in mine) <= size
    some = common.bounded_sample(table, ["id", "text"], 100, 10**6, 5, text="text").collect()
    nameless = sum(r["id"] is None for r in some)
    assert 0 < nameless < 60 and 40 < len(some) <= 100 and sum(r["text"] == "again" for r in some) == 0
    assert len(common.bounded_sample(table.limit(9), ["id"], 100, 10**6, 5, text="text").collect()) == 9
    assert common.bounded_sample(table.limit(0), ["id"], 5, 100, 5, text="text", by="k").collect() == []


def test_lookup_is_bounded_in_bytes(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t")
    hint = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hint(common.lookup(wide)) and not hint(common.lookup(wide, size=5000)) and not hint(common.lookup(wide, rows=9))


def test_coded_words_of_slices():
    """Pieces of a column, whose bytes do not begin at its first, too; white space is that of ASCII alone."""
    texts = ["A b\x0ba", " \t", None, "", "É\x85É é ", "\x1cß ſ\x00", "  x\r\ny"] * 40
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for a, b in ((0, 280), (3, 200), (279, 280), (1, 4), (5, 5)):
            coded, size = common.coded_words(column[a:b])
            want = [common.lower_words((t or "").encode()) for t in texts[a:b]]
            assert coded.to_pylist() == [w for t in want for w in t] and size.tolist() == [len(t) for t in want]
            assert common.listed(coded.dictionary) == list(dict.fromkeys(w for t in want for w in t))
