"""Text expressions; lengths and places count code points."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase delimiters and placeholder titles.
PHRASE_END = r"[，,。！!？?;；\n]"
PLACEHOLDER_TITLES = ("untitled", "untitled document")
MARKDOWN = r"^(?U)(\s*#{1,6}\s|\s*>|\s*[-*]\s|\s*\d+\.\s|`{3})"
FENCE = "```"
#: Characters that an overlap is looked up by, and places that are compared whole before the linear way.
OVERLAP_HEAD, OVERLAP_TRIES = 8, 16


def preview(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def ellipsis_preview(text: Column, size: int = 100) -> Column:
    """The first characters and an ellipsis, which short texts get as well."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def tail(text: Column, size: int) -> Column:
    return F.right(text, F.lit(size))


def head(text: Column, size: int) -> Column:
    return F.left(text, F.lit(size))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.rlike(r"^(?U)\s*$")


def first_phrase(text: Column) -> Column:
    """What stands before the first delimiter, leading white space stripped; empty if a delimiter leads."""
    return F.split(lstrip(text), PHRASE_END, 2)[0]


def _longest_end(head: str, tail: str) -> int:
    """Length of the longest head that ends the tail, in time linear in them; both are equally long."""
    back, n = array("i", bytes(4 * len(head))), 0
    for i in range(1, len(head)):
        while n and head[i] != head[n]:
            n = back[n - 1]
        n += head[i] == head[n]
        back[i] = n
    n = 0
    for c in tail:
        while n and c != head[n]:
            n = back[n - 1]
        n += c == head[n]
    return n


def overlap(text: str, prefix: str) -> int:
    """Length of the longest head of the text that the prefix ends with."""
    most = min(len(text), len(prefix))
    tail, head = prefix[len(prefix) - most :], text[:OVERLAP_HEAD]
    at = tail.find(head)
    for _ in range(OVERLAP_TRIES):
        if at < 0:
            return next((n for n in range(min(len(head) - 1, most), 0, -1) if tail.endswith(text[:n])), 0)
        if text.startswith(tail[at:]):
            return most - at
        at = tail.find(head, at + 1)
    return _longest_end(text[:most], tail)


def _overlaps(text: pa.Array, prefix: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else overlap(a, b) for a, b in zip(text.to_pylist(), prefix.to_pylist())], pa.int32())


def without_overlap(text: Column, prefix: Column) -> Column:
    """The text without its longest head that the prefix ends with."""
    return F.substring(text, F.coalesce(F.arrow_udf(_overlaps, "int")(text, prefix), F.lit(0)) + 1, F.length(text))


def word_count(text: Column) -> Column:
    return F.when(blank(text), 0).otherwise(F.size(F.split(strip(text), r"(?U)\s+")))


def cursor_line(before: Column) -> Column:
    return F.size(F.split(before, "\n"))


def cursor_column(before: Column) -> Column:
    return F.length(F.element_at(F.split(before, "\n"), -1)) + 1


def markdown_like(text: Column) -> Column:
    return text.rlike(MARKDOWN)


def paste_as_markdown(text: Column, html: Column) -> Column:
    """Markdown-like, and no HTML beside it or little of it."""
    return markdown_like(text) & (html.isNull() | (html == "") | (F.length(html) < F.length(text) * 1.5))


def at_end(text: Column, place: Column) -> Column:
    """Whether the next 50 characters are blank."""
    return blank(F.substring(text, place + 1, F.lit(50)))


def display_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def display_content(content: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), F.lit("No content"))


def normal_title(title: Column) -> Column:
    """Placeholder titles become empty."""
    known = F.coalesce(title, F.lit(""))
    return F.when(F.lower(strip(known)).isin(*PLACEHOLDER_TITLES), "").otherwise(known)


def completion_budget(prefix: Column) -> Column:
    """128 tokens inside what looks like a Python fence, else 64."""
    inside = (F.instr(prefix, FENCE) > 0) & F.contains(F.substring_index(prefix, FENCE, -1), F.lit("python"))
    return F.when(inside, 128).otherwise(64)


def cache_key(query: Column) -> Column:
    return F.concat(F.lit("rag:response:"), F.md5(query.cast("binary")))


def join_path(base: Column, path: str) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit(path))


def completion_url(base: Column, default: str) -> Column:
    return F.when(base.isNull() | (base == ""), F.lit(default)).otherwise(join_path(base, "/completions"))


def reply_text(raw_json: Column) -> Column:
    """Text of the first choice, else the content field, else empty."""
    return F.coalesce(F.get_json_object(raw_json, "$.choices[0].text"), F.get_json_object(raw_json, "$.content"), F.lit(""))


def body_text(body: Column, field: str = "text") -> Column:
    return F.coalesce(F.get_json_object(body, f"$.{field}"), F.lit(""))


def source_name(source: Column) -> Column:
    return F.coalesce(source, F.lit("Unknown"))
