"""Exact top-k inner-product search over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, and the table is
range-partitioned by that key. A task cuts its rows into annuli of few hundred rows that
share a pivot. For a query at distance d from the pivot, the triangle inequality puts
all vectors of an annulus [a, b] at least max(a - d, d - b, 0) away, which bounds their
inner product from above; annuli are expanded from the best bound on, and a query stops
once its k-th score beats the next bound.

Scores are exact integers. Floats serve for bounds only, which are widened against
rounding. The queries are numbered and taken in blocks of bounded bytes, however they are
partitioned; each block is one pass over the index, whose hits are stored before the next.

Defined cases: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows without an id; vectors of another length than the query's are no
candidates for it, nor is any row of the query's own id; rows that repeat id and vector
are one row, as query and as candidate; rows that repeat an id with another vector are
each a query, ranked by itself, and a candidate; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark.errors import AnalysisException

from .common import hash_sample, lookup, pinned, shared_path, shuffle_partitions, with_ordinal

#: Components become floor(SCALE * x).
SCALE = 1024
#: Pivots and first thresholds come from a sample of at most this many rows.
SAMPLE_ROWS = 4096
PIVOTS = 64
ANNULUS_ROWS = 256
#: Bytes of query vectors that one pass over the index carries.
QUERY_BYTES = 16_000_000
#: Queries that a task bounds against its annuli at a time.
QUERY_ROWS = 1024
SEED = 71


def scaled(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Usable rows as (id, v): v holds the integer components."""
    v = table[vec_col]
    lost = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return table.filter(table[id_col].isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~lost).select(
        table[id_col].cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long")).alias("v"),
    )


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, in floats; clipped where rounding goes below zero."""
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0.0))


def far_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice from the sample; fewer where it has fewer distinct rows."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats while every partial sum fits 53 bits, else as integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return q @ x.T
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def _merge(best: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, new: np.ndarray, k: int) -> None:
    """Fold candidates (one row per query of ``rows``) into its k best, ties to smaller ids."""
    s = np.concatenate([best[rows], scores], axis=1)
    i = np.concatenate([ids[rows], new], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    best[rows] = np.take_along_axis(s, order, 1)
    ids[rows] = np.take_along_axis(i, order, 1)


NONE = np.iinfo(np.int64).min + 1


def search_rows(
    ids: np.ndarray, x: np.ndarray, cell: np.ndarray, far: np.ndarray, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, floor: np.ndarray, best: np.ndarray, found: np.ndarray, annulus: int
) -> None:
    """Fold the given rows into the k best (scores and ids) of each query, where they can reach ``floor``."""
    k = best.shape[1]
    order = np.lexsort((far, cell))
    ids, x, cell, far = ids[order], x[order], cell[order], far[order]
    cuts = np.flatnonzero(np.diff(cell)) + 1
    starts = np.concatenate([np.arange(a, b, annulus) for a, b in zip([0, *cuts], [*cuts, len(cell)])])
    # An annulus that would run into the next cell ends with its own.
    stops = np.concatenate([starts[1:], [len(cell)]])
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q_far = _distances(qf, pivots)
    q_sq, x_sq = (qf * qf).sum(1), (xf * xf).sum(1)
    inner, outer, at = far[starts], far[stops - 1], cell[starts]
    largest = np.maximum.reduceat(x_sq, starts)
    gap = np.maximum(np.maximum(inner[None, :] - q_far[:, at], q_far[:, at] - outer[None, :]), 0.0)
    size = q_sq[:, None] + largest[None, :]
    bound = (size - gap * gap) / 2 + 1e-6 * size + 1.0
    ranked = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(q))
    for turn in range(len(starts)):
        block = ranked[live, turn]
        reach = np.maximum(best[live, k - 1], floor[live])
        keep = bound[live, block] >= reach
        live, block = live[keep], block[keep]
        if not len(live):
            break
        for b in np.unique(block):
            rows = live[block == b]
            a, z = starts[b], stops[b]
            scores = _scores(q[rows], x[a:z])
            scores[q_ids[rows][:, None] == ids[None, a:z]] = NONE
            _merge(best, found, rows, scores, np.broadcast_to(ids[a:z], scores.shape), k)


def top_k_search(
    table: DataFrame,
    queries: DataFrame,
    k: int = 10,
    n_pivots: int = PIVOTS,
    sample_rows: int = SAMPLE_ROWS,
    query_bytes: int = QUERY_BYTES,
    annulus: int = ANNULUS_ROWS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """For each query row its k best rows: query_id, rank (from 1), vec_id, score."""
    spark: SparkSession = table.sparkSession
    out = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]
    )
    rows, asked = scaled(table, id_col, vec_col), scaled(queries, id_col, vec_col).distinct()
    # Only ids are shuffled to find repeated ones; their few rows are then made distinct.
    again = lookup(rows.groupBy(F.col("id").alias("_again")).agg(F.count("*").alias("n")).filter("n > 1").select("_again"))
    if not again.isEmpty():
        met = F.col("id") == F.col("_again")
        rows = rows.join(again, met, "left_anti").unionByName(rows.join(again, met, "left_semi").distinct())
    path = shared_path(spark, "hits")
    for (dim,) in rows.select(F.size("v")).distinct().collect():
        _search_dim(spark, rows.filter(F.size("v") == dim), asked.filter(F.size("v") == dim), dim, path, k, n_pivots, sample_rows, query_bytes, annulus)
    try:
        return spark.read.schema(out).parquet(path)
    except AnalysisException:  # no query has been asked
        return spark.createDataFrame([], out)


def _search_dim(spark: SparkSession, rows: DataFrame, asked: DataFrame, dim: int, path: str, k: int, n_pivots: int, sample_rows: int, query_bytes: int, annulus: int) -> None:
    held = pinned(with_ordinal(asked, ["id"], "no"))
    n = held.count()
    if not n:
        return
    sample = hash_sample(rows, "id", sample_rows, SEED).orderBy("id").limit(sample_rows).toArrow()
    s_ids = sample["id"].to_numpy()
    s_vec = _matrix(sample["v"].combine_chunks(), dim) if len(s_ids) else np.zeros((0, dim), np.int64)
    pivots = far_pivots(s_vec.astype(np.float64), n_pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(1), dim).astype(np.float64), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "far"]
                )

    # The id in the key splits even equal vectors over partitions.
    index = pinned(
        rows.mapInArrow(keyed, "id bigint, v array<bigint>, cell int, far double").repartitionByRange(shuffle_partitions(spark), "cell", "far", "id")
    )
    step = max(1, query_bytes // (8 * dim))
    for a in range(0, n, step):
        block = held.filter((F.col("no") >= a) & (F.col("no") < a + step)).orderBy("no").toArrow()
        _search_block(spark, index, block, s_ids, s_vec, pivots, dim, k, annulus).write.mode("append").parquet(path)


def _floors(q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s_vec: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best of each query reaches at least, from the sample."""
    floor = np.full(len(q), NONE)
    if len(s_ids) <= k:
        return floor
    best = np.full((len(q), k), NONE)
    dummy = np.zeros((len(q), k), np.int64)
    for b in range(0, len(q), QUERY_ROWS):
        part = np.arange(b, min(b + QUERY_ROWS, len(q)))
        for a in range(0, len(s_ids), 512):
            scores = _scores(q[part], s_vec[a : a + 512])
            scores[q_ids[part, None] == s_ids[None, a : a + 512]] = NONE
            _merge(best, dummy, part, scores, np.broadcast_to(s_ids[a : a + 512], scores.shape), k)
    return best[:, k - 1]


def _search_block(spark: SparkSession, index: DataFrame, block: pa.Table, s_ids: np.ndarray, s_vec: np.ndarray, pivots: np.ndarray, dim: int, k: int, annulus: int) -> DataFrame:
    q_ids, q = block["id"].to_numpy(), _matrix(block["v"].combine_chunks(), dim)
    sent = spark.sparkContext.broadcast((block["no"].to_numpy(), q_ids, q, pivots, _floors(q_ids, q, s_ids, s_vec, k)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q_ids, q, pivots, floor = sent.value
        best, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            if batch.num_rows:
                held = batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                for a in range(0, len(q), QUERY_ROWS):
                    part = slice(a, a + QUERY_ROWS)
                    search_rows(*held, q_ids[part], q[part], pivots, floor[part], best[part], ids[part], annulus)
        for a in range(0, len(q), QUERY_ROWS):
            row, col = np.nonzero(best[a : a + QUERY_ROWS] != NONE)
            row += a
            yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(q_ids[row]), pa.array(ids[row, col]), pa.array(best[row, col])], ["no", "query_id", "vec_id", "score"])

    hits = index.mapInArrow(search, "no bigint, query_id bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
