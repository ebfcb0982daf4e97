"""Table schemas of the document store."""

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in columns])


_INT, _LONG, _TEXT, _BOOL, _TIME = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()

FOLDERS = _table(
    ("id", _INT, False), ("title", _TEXT, False), ("parent_id", _INT, True), ("is_active", _BOOL, False), ("created_at", _TIME, True), ("updated_at", _TIME, True)
)
DOCUMENTS = _table(
    ("id", _LONG, False),
    ("title", _TEXT, False),
    ("content", _TEXT, True),
    ("summary", _TEXT, True),
    ("tags", _TEXT, True),
    ("version", _INT, False),
    ("is_active", _BOOL, False),
    ("created_at", _TIME, False),
    ("updated_at", _TIME, True),
    ("folder_id", _INT, True),
)
SYSTEM_LOGS = _table(
    ("id", _LONG, False),
    ("user_id", _TEXT, True),
    ("timestamp", _TIME, False),
    ("action", _TEXT, False),
    ("resource_type", _TEXT, True),
    ("resource_id", _TEXT, True),
    ("details", _TEXT, True),
    ("status", _TEXT, True),
    ("error_message", _TEXT, True),
)
CHUNK_VECTORS = _table(
    ("doc_id", _LONG, False),
    ("chunk_no", _INT, False),
    ("page_content", _TEXT, False),
    ("headers", T.MapType(_TEXT, _TEXT), True),
    ("source", _TEXT, True),
    ("embedding", T.ArrayType(T.FloatType()), False),
)
#: Columns that responses carry.
DOCUMENT_LIST = ["id", "title", "content", "folder_id", "created_at", "updated_at"]
FOLDER_VIEW = ["id", "title", "parent_id"]
