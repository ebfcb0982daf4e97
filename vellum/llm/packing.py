"""Conflict-constrained best-fit packing of documents into fixed-length training sequences.

Documents are measured in words plus one end mark and cut into pieces of at most the
capacity. A piece goes into the bin with the least room that still holds it and with
which it has no conflict: no bin takes two pieces of one duplicate cluster, nor more
than ``per_source`` pieces of one source. Each bin carries bitmaps for both; the search
goes on to the next larger room until a compatible bin is found, else a bin is opened.

Packing is done in cells of about ``cell_rows`` documents, dealt by a hash of the row,
so memory per task is bounded and hot sources or clusters spread over all cells. A piece of
the whole capacity is a bin by itself, so the search sees one piece a document at most,
however long the documents are.

Defined cases: a null or empty text is one end mark; a null source is a source of its
own; null ids are packed like others; repeated rows are packed each, and conflict with
each other as copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, word_counts

CAPACITY = 2048
PER_SOURCE = 3
CELL_ROWS = 4_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, items taken largest first, ties in the given order.

    ``rooms`` is a bitmap of the residuals that some bin has; the successor of a size is
    its lowest set bit from there on. Per bin, ``planes[j]`` has the sources taken more
    than ``j`` times and ``seen`` the clusters, as integers used as bitmaps.
    """
    room: list[int] = []
    planes: list[list[int]] = []
    seen: list[int] = []
    at: dict[int, list[int]] = {}
    rooms = 0
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, source, cluster = sizes[i], 1 << sources[i], 1 << clusters[i]
        chosen, least = -1, size
        while chosen < 0:
            rest = rooms >> least
            if not rest:
                break
            least += (rest & -rest).bit_length() - 1
            for b in at[least]:
                if not (seen[b] & cluster or planes[b][per_source - 1] & source):
                    chosen = b
                    break
            else:
                least += 1
        if chosen < 0:
            chosen = len(room)
            room.append(capacity)
            planes.append([0] * per_source)
            seen.append(0)
        else:
            at[room[chosen]].remove(chosen)
            if not at[room[chosen]]:
                del at[room[chosen]]
                rooms ^= 1 << room[chosen]
        bins[i], offsets[i] = chosen, capacity - room[chosen]
        seen[chosen] |= cluster
        for j, plane in enumerate(planes[chosen]):
            if not plane & source:
                planes[chosen][j] |= source
                break
        left = room[chosen] = room[chosen] - size
        if left:
            at.setdefault(left, []).append(chosen)
            rooms |= 1 << left
    return bins, offsets


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, tokens (words and one end mark) and cluster (a hash of the folded text)."""
    id_type, source_type = (docs.schema[c].dataType.simpleString() for c in (id_col, source_col))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            counts = pa.array(word_counts(batch.column(3)) + 1, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts], ["id", "source", "cluster", "tokens"])

    folded = F.xxhash64(F.lower(F.coalesce(docs[text_col], F.lit(""))))
    return docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), folded.alias("cluster"), docs[text_col].alias("text")
    ).mapInArrow(measure, f"id {id_type}, source {source_type}, cluster bigint, tokens bigint")


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    cell_rows: int = CELL_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: id, piece, start (in the document's tokens), tokens, cell, bin, offset.

    Pieces of one document follow each other from ``piece`` 0; only full pieces and a
    shorter last one occur. (cell, bin) names a sequence.
    """
    rows = docs.select(F.lit(1)).count()
    cells = max(1, -(-rows // cell_rows))
    cell = F.pmod(F.xxhash64(F.lit(cells), "id", "cluster"), F.lit(cells)).cast("long")
    items = measured(docs, id_col, text_col, source_col).withColumn("cell", cell)
    id_type = items.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("tokens", "ascending"), ("cluster", "ascending")]).combine_chunks()
        tokens, cluster = table["tokens"].to_numpy(), table["cluster"].to_numpy()
        pieces = np.maximum(1, -(-tokens // capacity))
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        size = np.minimum(tokens[row] - start, capacity)
        sources = table["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[row]
        # Pieces of one document are different texts; equal pieces of copies conflict.
        part = np.flatnonzero(size < capacity)
        _, groups = np.unique(np.stack([cluster[row[part]], piece[part]]), axis=1, return_inverse=True)
        found, at = best_fit(size[part].tolist(), sources[part].tolist(), groups.ravel().tolist(), capacity, per_source)
        whole = np.flatnonzero(size == capacity)
        bins, offsets = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        bins[whole], bins[part], offsets[part] = np.arange(len(whole)), np.array(found, np.int64) + len(whole), at
        return pa.table(
            {
                "id": table["id"].take(pa.array(row)),
                "piece": piece.astype(np.int32),
                "start": start.astype(np.int64),
                "tokens": size.astype(np.int64),
                "cell": table["cell"].take(pa.array(row)),
                "bin": bins,
                "offset": offsets,
            }
        )

    schema = f"id {id_type}, piece int, start bigint, tokens bigint, cell bigint, bin bigint, offset bigint"
    return items.groupBy("cell").applyInArrow(pack, schema)
