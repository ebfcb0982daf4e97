import math
import random

import numpy as np

from vellum.llm import topk


def brute(rows, queries, k):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in usable:
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def rows():
    rng = random.Random(1)
    out = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(300)]
    out += [(1000 + i, [0.5] * 6) for i in range(200)]
    return out + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2100, [1.0, 2.0]), (2200, [3.0, 1.0]), (2300, [])]


def test_matches_brute_force(spark):
    data = rows()
    table = spark.createDataFrame([(i, v, 1, "s") for i, v in data], "vec_id long, embedding array<float>, rank int, score string")
    asked = table.filter("vec_id % 100 = 0")
    for size, annulus in ((10**6, 32), (150, 7)):
        got = topk.top_k_search(table, asked, k=5, n_pivots=8, sample_rows=64, query_bytes=size, annulus=annulus).collect()
        assert {tuple(r) for r in got} == brute(data, {i for i, _ in data if i is not None and i % 100 == 0}, 5)
        assert len(got) == len(set(got))


def test_empty_and_alone(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert topk.top_k_search(table, table).collect() == []
    assert topk.top_k_search(table.limit(0), table.limit(0)).collect() == []


def test_large_components_stay_exact():
    q, x = np.array([[2**31 + 1, 3]]), np.array([[2**30 + 7, -5]])
    assert topk._scores(q, x)[0, 0] == (2**31 + 1) * (2**30 + 7) - 15


def test_bounds_prune():
    """Far annuli are not scored once the floor is reached."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(900, 1100, (200, 4)), rng.integers(-1100, -900, (200, 4))])
    pivots = np.array([[1000.0] * 4, [-1000.0] * 4])
    d = topk._distances(x.astype(float), pivots)
    calls, plain = [], topk._scores
    topk._scores = lambda q, r: calls.append(len(r)) or plain(q, r)
    try:
        best, ids = np.full((1, 5), topk.NONE), np.zeros((1, 5), np.int64)
        topk.search_rows(np.arange(400), x, d.argmin(1), d.min(1), np.array([0]), x[:1], pivots, np.array([topk.NONE]), best, ids, 50)
    finally:
        topk._scores = plain
    assert sum(calls) <= 200


def test_repeated_rows(spark):
    """Equal rows are one; a repeated id with another vector is a row, and a query, of its own."""
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(100, [0.5] * 4)] * 2 + [(7, [0.9] * 4)] * 3
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k_search(table, table.filter("vec_id in (100, 7)")).collect()
    mine = [r["vec_id"] for r in got if r["query_id"] == 100]
    one = sorted(((-sum(a * b for a, b in zip([512] * 4, (math.floor(1024 * x) for x in v))), i) for i, v in {(i, tuple(v)) for i, v in data if i != 100}))[:10]
    assert sorted((-r["score"], r["vec_id"]) for r in got if r["query_id"] == 100) == one and len(mine) == 10
    assert sorted(r["rank"] for r in got if r["query_id"] == 7) == sorted(list(range(1, 11)) * 2)


def test_plan_does_not_grow_with_the_partitions_of_the_queries(spark):
    data = [(i, [float(i % 7), 1.0]) for i in range(500)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(40)
    found = topk.top_k_search(table, table.filter("vec_id % 10 = 0"))
    assert len(found._jdf.queryExecution().executedPlan().toString().splitlines()) < 10 and found.count() == 500
