"""Where tables live: storage address, the shared folder, Parquet or JDBC reads, the chunk table and log sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CHUNK_VECTORS


def storage_uri(server: str | None, path: str, port: int = 5432, database: str = "") -> str:
    """A folder of Parquet tables where no server, or the embedded one, is named; else a JDBC address, without credentials."""
    if not server or server == "sqlite":
        return path
    return f"jdbc:postgresql://{server}:{port}/{database}"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vellum-ckpt-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # Only a path that is there can be marked; writers want a fresh one in it.
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def open_table(
    spark: SparkSession, uri: str, table: str, schema: T.StructType | None = None, user: str = "", password: str = "", split: tuple[str, int, int, int] | None = None
) -> DataFrame:
    """A stored table. ``split`` (column, lowest, highest, parts) lets as many tasks read a JDBC table."""
    if uri.startswith("jdbc:"):
        reader = spark.read.format("jdbc").options(url=uri, dbtable=table, user=user, password=password)
        if split:
            column, low, high, parts = split
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{uri.rstrip('/')}/{table}")


def open_vectors(spark: SparkSession, uri: str, table: str = "chunk_vectors") -> DataFrame:
    """The vector store: chunks with their embeddings; made empty where it is missing."""
    create_tables(spark, uri, {table: CHUNK_VECTORS})
    return open_table(spark, uri, table, CHUNK_VECTORS)


def create_tables(spark: SparkSession, uri: str, schemas: dict[str, T.StructType]) -> None:
    """Create the tables that are missing, empty."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{uri.rstrip('/')}/{name}")


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Audit and request logs: append only."""
    rows.write.mode("append").parquet(path)


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """One batch of a table, in a folder of its own that a second run replaces."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


#: Levels of log rows in ascending order.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def at_least(logs: DataFrame, level: str, column: str = "level") -> DataFrame:
    """Log rows of the level and above."""
    return logs.filter(F.col(column).isin(*LEVELS[LEVELS.index(level) :]))


def append_logs(logs: DataFrame, path: str, level: str = "DEBUG", ts: str = "ts") -> None:
    """The file sink of logs: a folder a day, in bounded compressed files."""
    rows = at_least(logs, level).withColumn("day", F.to_date(ts))
    rows.write.mode("append").partitionBy("day").option("maxRecordsPerFile", 100_000).option("compression", "zstd").parquet(path)


def retained(logs: DataFrame, now: Column, days: int = 10) -> DataFrame:
    """Logs of the last days; whole day folders are skipped."""
    return logs.filter(F.col("day") >= F.date_sub(F.to_date(now), days))


def without_documents(chunks: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks but for those of the given documents; write the result to a new folder."""
    return chunks.join(doc_ids.select(key).distinct(), key, "left_anti")


#: Keys that travel to the rows of a table at a time.
HELD_KEYS = 1_000_000


def of_keys(rows: DataFrame, keys: DataFrame, key: str, held: int = HELD_KEYS) -> DataFrame:
    """Rows whose ``key`` is among the keys. Keys travel in blocks to a scan of the rows each, so that no row is shuffled, however many keys there are."""
    wanted = keys.select(key).distinct()
    blocks = max(1, -(-wanted.count() // held))
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    met = [rows.join(F.broadcast(wanted.filter(block == b) if blocks > 1 else wanted), key, "left_semi") for b in range(blocks)]
    return reduce(DataFrame.unionAll, met)


def of_active_documents(chunks: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    active = documents.filter("is_active").select(F.col("id").alias(key))
    return chunks.join(active, key, "left_semi")
