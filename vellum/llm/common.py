"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_path, shared_root  # noqa: F401

#: Rows, and bytes as JSON, up to which a lookup table is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000
#: Bytes of text that Python works on at a time.
SLICE_BYTES = 16_000_000
#: Monotonic ids hold the row's place in its partition in their low 33 bits.
_PLACE = (1 << 33) - 1
#: Bytes that separate words: space and U+0009 to U+000D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; rows keep their partition and order."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A join side: broadcast if it was counted and measured to be small, else a plain table.

    It is pinned first, so that a shuffled join against it reads an exchange on both
    sides and adaptive execution can split a hot key.
    """
    held = pinned(df)
    if held.count() > rows:
        return held
    taken = held.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(held) if taken <= size else held


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_ordinal(df: DataFrame, order: list[str], name: str, ties: list[str] | None = None) -> DataFrame:
    """Number all rows from 0 by ``order`` then ``ties`` without gathering them in one task.

    Range partitions are sorted and pinned; the ordinal is the row's place in its
    partition plus the rows before it. Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, *(ties or []))
    held = pinned(ranged)
    at = F.monotonically_increasing_id()
    numbered = held.withColumn("_pid", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND(F.lit(_PLACE)))
    counts = sorted((r["_pid"], r["n"]) for r in numbered.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for pid, n in counts:
        offsets.append((pid, before))
        before += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _before long")
    return (
        numbered.join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_pid", "_place", "_before")
    )


def bytes_of(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """A text column as UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def flat(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and each text's start in it, with the end."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_counts(column: pa.Array) -> np.ndarray:
    """Words, as runs without white space, of each text."""
    data, offsets = flat(bytes_of(column))
    solid = ~_SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = solid[first]
    total = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def lower_words(text: bytes) -> list[bytes]:
    """Words split at ASCII white space, A-Z in lower case."""
    return text.lower().split()


def coded_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """lower_words of all texts, one text's after the other's, each distinct word held once; and the number of words of each text."""
    # Lowered here, from the start of the bytes: pc.ascii_lower goes wrong on slices (pyarrow 23).
    data, offsets = flat(bytes_of(column))
    lowered = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(data.tobytes().lower()))
    met = pc.ascii_split_whitespace(lowered)
    words, ends = met.flatten().view(pa.large_binary()), met.offsets.to_numpy()
    # Empty pieces stand before and behind white space at a text's ends.
    solid = pc.binary_length(words).to_numpy() > 0
    total = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    coded = (words if total[-1] == len(words) else words.filter(pa.array(solid))).dictionary_encode()
    return coded, np.diff(total[ends])


def listed(words: pa.Array) -> list[bytes]:
    """Words as a list; to_pylist takes ten times as long."""
    return words.to_numpy(zero_copy_only=False).tolist()


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of at most ``rows`` rows and about ``size`` bytes of text; a longer row is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, before + size, "right"))
            to = min(max(fit, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_fold(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most about ``rows`` rows of ``df``, those of the smallest seeded hash of ``key``.

    Only hashes are sorted for the bound; wide columns are read after the filter.
    """
    mark = F.xxhash64(F.lit(seed), F.col(key))
    marks = df.select(mark.alias("m")).orderBy("m").limit(rows)
    last = marks.agg(F.max("m"), F.count("*")).first()
    return df.filter(mark <= F.lit(last[0])) if last[1] >= rows else df


def bounded_sample(df: DataFrame, keys: list[str], rows: int, size: int, seed: int, text: str | None = None, by: str | None = None) -> DataFrame:
    """Rows of ``df`` of the smallest seeded hashes of ``keys``, of each value of ``by`` if given.

    At most ``rows`` rows and ``size`` bytes of ``text`` (of each value). Rows of one hash, as
    repeated rows are, enter together; not at all if they alone take over an eighth of a bound. A first cut by the share of rows leaves about twice the bound; only its
    hashes are gathered.
    """
    unit = F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    marked = df.withColumn("_unit", unit).withColumn("_by", F.col(by) if by else F.lit(0))
    if by:
        shares = lookup(marked.groupBy(F.col("_by").alias("_of")).agg((F.lit(2.0 * rows) / F.count("*")).alias("_share")))
        near = marked.join(shares, F.col("_by").eqNullSafe(F.col("_of"))).filter(F.col("_unit") < F.col("_share")).drop("_of", "_share")
    else:
        near = marked.filter(F.col("_unit") < F.lit(2.0 * rows / max(df.select(F.lit(1)).count(), 1)))
    taken = F.sum(F.coalesce(F.octet_length(text), F.lit(0))) if text else F.lit(0)
    last: dict = {}
    left_out = []
    full: dict[object, list[int]] = {}
    for r in near.groupBy("_by", "_unit").agg(F.count("*").alias("n"), taken.alias("size")).orderBy("_unit").collect():
        held = full.setdefault(r["_by"], [0, 0])
        if r["n"] > max(rows // 8, 1) or r["size"] > size // 8:
            left_out.append(r["_unit"])
        elif held[0] + r["n"] > rows or held[1] + r["size"] > size:
            held[0] = rows + 1
        else:
            held[0], held[1] = held[0] + r["n"], held[1] + r["size"]
            last[r["_by"]] = r["_unit"]
    if not last:
        return near.limit(0).drop("_unit", "_by")
    within = F.lit(False)
    for value, end in last.items():
        within = within | (F.col("_by").eqNullSafe(F.lit(value)) & (F.col("_unit") <= F.lit(end)))
    if left_out:
        within = within & ~F.col("_unit").isin(left_out)
    return near.filter(within).drop("_unit", "_by")


def least_count(counts: DataFrame, column: str, rows: int) -> int:
    """The smallest bound that at most ``rows`` rows of ``counts`` reach in ``column``.

    Found from a histogram, whose upper end is one bar that doubles while it holds too many.
    """
    cap = 10_000
    bars = counts.groupBy(F.least(F.col(column), F.lit(cap)).alias("bar")).agg(F.count("*").alias("rows")).collect()
    held = {r["bar"]: r["rows"] for r in bars}
    least, reached = cap, held.pop(cap, 0)
    while reached > rows:
        least *= 2
        reached = counts.filter(F.col(column) >= least).count()
    if least == cap:
        for bar in sorted(held, reverse=True):
            if reached + held[bar] > rows:
                break
            least, reached = bar, reached + held[bar]
    return least
