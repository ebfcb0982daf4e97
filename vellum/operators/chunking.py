"""Cutting documents into chunks for retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1000, 200
LEVELS = 3
#: Cut places, tried in turn; the last cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")
_HEADER = re.compile(r"(#{1,%d})(?:[ \t]+(.*))?$" % LEVELS)
_FENCE = re.compile(r"(```|~~~)")
CHUNK = "doc_id bigint, chunk_no int, page_content string, headers map<string,string>, source string"


def header_sections(text: str) -> list[tuple[str, dict[str, str]]]:
    """Sections between headers of levels 1 to 3, with the headers above each.

    Header lines leave the text. Lines inside fences are text. A header ends those of its
    level and deeper; neighbouring lines under the same headers are one section.
    """
    sections: list[tuple[list[str], dict[str, str]]] = []
    above: dict[int, str] = {}
    fence = ""
    for line in text.split("\n"):
        bare = line.strip()
        mark = _FENCE.match(bare)
        if fence:
            fence = "" if mark and mark[1] == fence else fence
        elif mark:
            # A fence that closes on its own line opens nothing.
            fence = "" if bare.count(mark[1]) > 1 else mark[1]
        elif found := _HEADER.match(bare):
            level = len(found[1])
            above = {k: v for k, v in above.items() if k < level} | {level: (found[2] or "").strip()}
            continue
        names = {f"Header {k}": v for k, v in sorted(above.items())}
        if sections and sections[-1][1] == names:
            sections[-1][0].append(line)
        else:
            sections.append(([line], names))
    joined = [("\n".join(lines).strip("\n"), names) for lines, names in sections]
    return [(body, names) for body, names in joined if body.strip()]


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most the size, each with the separator that stood before it."""
    if len(text) <= size:
        return [text]
    sep = next((s for s in separators if s == "" or s in text), "")
    if sep == "":
        return list(text)
    rest = separators[separators.index(sep) + 1 :]
    parts = text.split(sep)
    out = []
    for i, part in enumerate(parts):
        piece = part if i == 0 else sep + part
        if piece:
            out += _pieces(piece, size, rest) if len(piece) > size else [piece]
    return out


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most the size, which begin with whole trailing pieces of the one before, at most the overlap."""
    chunks: list[str] = []
    held: list[str] = []
    total = 0

    def close() -> None:
        chunk = "".join(held).strip()
        if chunk:
            chunks.append(chunk)

    for piece in _pieces(text, size, SEPARATORS):
        if held and total + len(piece) > size:
            close()
            drop = 0
            while drop < len(held) and (total > overlap or total + len(piece) > size):
                total -= len(held[drop])
                drop += 1
            held = held[drop:]
        held.append(piece)
        total += len(piece)
    close()
    return chunks


def markdown_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, dict[str, str]]]:
    """Header sections cut to size; text of which no section is left is cut as it is."""
    found = [(chunk, names) for body, names in header_sections(text) for chunk in split_text(body, size, overlap)]
    return found or [(chunk, {}) for chunk in split_text(text, size, overlap)]


def chunk_documents(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_no, page_content, headers and source of all chunks of documents with content, and the columns to carry."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            ids, numbers, texts, names, titles, rows = [], [], [], [], [], []
            for row, (i, title, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                for n, (chunk, headers) in enumerate(markdown_chunks(text, size, overlap)):
                    ids.append(i)
                    numbers.append(n)
                    texts.append(chunk)
                    names.append(list(headers.items()))
                    titles.append(title)
                    rows.append(row)
            carried = [batch.column(3 + c).take(pa.array(rows, pa.int64())) for c in range(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(names, kind), pa.array(titles, pa.string()), *carried],
                ["doc_id", "chunk_no", "page_content", "headers", "source", *carry],
            )

    rows = documents.filter(F.col("content").isNotNull() & (F.col("content") != "")).select(F.col("id").cast("long"), "title", "content", *carry)
    return rows.mapInArrow(cut, ", ".join([CHUNK, *(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carry)]))


def fixed_chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of fixed stride, native: doc_id, chunk_no, page_content, source, and the columns to carry."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("content") - overlap, F.lit(1)), F.lit(size - overlap))
    rows = documents.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    return rows.select(F.col("id").alias("doc_id"), F.col("title").alias("source"), "content", *carry, F.posexplode(starts).alias("chunk_no", "_start")).select(
        "doc_id", "chunk_no", F.substring("content", F.col("_start"), F.lit(size)).alias("page_content"), "source", *carry
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
