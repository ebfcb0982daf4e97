"""Lookups, lists, folder contents and the folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..sources.schemas import DOCUMENT_LIST


def active(table: DataFrame) -> DataFrame:
    return table.filter("is_active")


def document_by_id(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.filter((F.col("id") == doc_id) & F.col("is_active"))


def folder_by_id(folders: DataFrame, folder_id: int) -> DataFrame:
    """Inactive folders are found too."""
    return folders.filter(F.col("id") == folder_id)


def one_or_none(found: DataFrame):
    """The only row, or None; more than one is an error."""
    rows = found.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row where at most one may be")
    return rows[0] if rows else None


def document_list(documents: DataFrame, size: int = 200) -> DataFrame:
    """Active documents with previews, latest update first, never updated ones last."""
    return (
        active(documents).withColumn("content", X.preview(F.col("content"), size)).select(*DOCUMENT_LIST).orderBy(F.desc_nulls_last("updated_at"), "id")
    )


def first_document(documents: DataFrame) -> DataFrame:
    return document_list(documents).limit(1)


def newest_first(documents: DataFrame) -> DataFrame:
    return active(documents).orderBy(F.desc("created_at"), F.desc("id"))


def root_or(folder_id: int | None) -> Column:
    """Folder 0 stands for the root."""
    return F.nullif(F.lit(folder_id).cast("int"), F.lit(0))


def child_folders(folders: DataFrame, folder_id: int | None) -> DataFrame:
    return active(folders).filter(F.col("parent_id").eqNullSafe(root_or(folder_id)))


def child_documents(documents: DataFrame, folder_id: int | None) -> DataFrame:
    return active(documents).filter(F.col("folder_id").eqNullSafe(root_or(folder_id)))


def folder_contents(folders: DataFrame, documents: DataFrame, folder_id: int | None) -> DataFrame:
    """(kind, id, title): both lists of a folder in one table."""
    parts = (("folder", child_folders(folders, folder_id)), ("document", child_documents(documents, folder_id)))
    a, b = (rows.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "title") for kind, rows in parts)
    return a.unionByName(b)


def with_folder(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents with their folder's title; dangling folder ids keep the document."""
    names = folders.select(F.col("id").alias("_folder"), F.col("title").alias("folder_title"))
    return documents.join(names, F.col("folder_id") == F.col("_folder"), "left").drop("_folder")


def folder_paths(spark: SparkSession, folders: DataFrame, sep: str = "/") -> DataFrame:
    """(id, path, depth) of every folder reachable from a root.

    The tree is walked by a recursive query, under the session's limits of
    spark.sql.cteRecursionLevelLimit levels and spark.sql.cteRecursionRowLimit rows.
    """
    return spark.sql(
        """
        WITH RECURSIVE tree(id, path, depth) AS (
            SELECT id, title, 0 FROM {folders} WHERE parent_id IS NULL
            UNION ALL
            SELECT f.id, concat(t.path, {sep}, f.title), t.depth + 1 FROM {folders} f JOIN tree t ON f.parent_id = t.id
        )
        SELECT id, path, depth FROM tree
        """,
        folders=folders,
        sep=sep,
    )


def answerable(messages: DataFrame, column: str = "text") -> DataFrame:
    """Messages that are not blank."""
    return messages.filter(~X.blank(F.col(column)))


def as_json(documents: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(id, json) of every document, times as ISO text, nulls kept."""
    kinds = dict(documents.dtypes)
    fields = [(D.iso(F.col(c)) if kinds[c].startswith("timestamp") else F.col(c)).alias(c) for c in columns or DOCUMENT_LIST]
    return documents.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    return rows.select("id", F.from_json(column, schema).alias("_row")).select("_row.*")


def insert_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Folders with new active ones behind them; parent 0 is the root."""
    rows = new.select("id", "title", F.nullif("parent_id", F.lit(0)).alias("parent_id"), F.lit(True).alias("is_active"))
    return folders.unionByName(rows)
