"""Near copies by SimHash: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Every text gets ``VARIANTS`` fingerprints of independent hashes over its distinct words,
which a replaced word disturbs less than it does shingles, and the Golay keys of each (see
simhash): an equal segment and a codeword index near the bits behind it. Rows travel by
segment, once for each, and meet by index where they arrive. Texts that share a key, whose
remaining bits differ in ``REST_BITS`` at most and whose set sizes allow the similarity are
candidates, and every candidate is held against the sets themselves, so no link is below
the threshold.

Texts of one set are one node. Candidates of one segment make up clusters. A cluster of up
to ``PAIR_ROWS`` nodes gives its pairs, which meet their sets by join; to a larger one the
sets travel, and it gives a spanning forest of its verified links, not its pairs.

Defined cases: a text of fewer than five words has all of them as its one shingle; null and
wordless texts are copies of each other; rows without an id stay; rows that repeat an id are
told apart by their sets; an empty table gives no rows; other columns are carried along,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bytes_of, lookup, lower_words, pinned, slices
from .components import connected_components
from .simhash import SEED, Golay, lowest, majority, remixed

SHINGLE, FEATURE = 5, 1
VARIANTS = 8
#: Bits outside the key, of 25, in which candidates may differ.
REST_BITS = 7
#: Nodes of a cluster that meet pair by pair.
PAIR_ROWS = 16
#: Words whose hashes a worker holds.
CODES = 1_000_000
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)


class _Codes(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return code


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int, codes: _Codes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and where each text's begin, with the end."""
    codes = _Codes() if codes is None else codes
    words = [[codes[w] for w in lower_words(t)] for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array([c for w in words for c in w], dtype=np.uint64)
    text = np.repeat(np.arange(len(texts)), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(flat))
    # A short text's only shingle is its first; words that it lacks count as zero.
    first = left == count[text]
    inside = (left >= size) | (first & (count[text] < size))
    h = np.zeros(len(flat), dtype=np.uint64)
    for j in range(size):
        there = np.flatnonzero(left > j)
        h[there] += _mixed(flat[there + j] + np.uint64(j + 1)) * np.uint64(2 * j + 1)
    h, text = _mixed(h[inside]), text[inside]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    return h, np.searchsorted(text, np.arange(len(texts) + 1))


def _split(sets: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    return [sets[0][a:b] for a, b in zip(sets[1][:-1], sets[1][1:])]


def set_node(held: np.ndarray) -> int:
    """The set's own hash, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).astype(np.int64))


def set_fingerprints(sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of VARIANTS fingerprints of each set."""
    h, at = sets
    return np.stack([majority(remixed(h, v), np.diff(at)) for v in range(VARIANTS)], axis=1)


def size_code(n: np.ndarray) -> np.ndarray:
    """Logarithmic size in seven bits; sizes of similar sets are at most three apart."""
    return np.minimum(np.log(np.maximum(n, 1)) / 0.11, 127).astype(np.int64)


def key_marks(fps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, keys and marks over all segments of the fingerprints (a row of variants each).

    A key names variant and segment and holds the segment's 16 bits. A mark has the 23 bits
    behind it, which are decoded, the 25 others and the size code.
    """
    keys, marks = [], []
    for v in range(fps.shape[1]):
        for i in range(4):
            parts = np.ascontiguousarray(fps[:, v]).view(np.uint16).reshape(-1, 4)
            turned = np.ascontiguousarray(np.roll(parts, -i, axis=1)).view(np.uint64).ravel()
            keys.append((v << 18 | i << 16) | (turned & np.uint64(0xFFFF)).astype(np.int64))
            word, rest = (turned >> np.uint64(16) & np.uint64(0x7FFFFF)).astype(np.int64), (turned >> np.uint64(39)).astype(np.int64)
            marks.append(word << 32 | rest << 7 | size_code(size))
    return np.tile(np.arange(len(fps)), 4 * fps.shape[1]), np.concatenate(keys), np.concatenate(marks)


def candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether marks of one key are near each other beyond it."""
    return (np.bitwise_count((a ^ b) >> 7 & 0x1FFFFFF) <= REST_BITS) & (np.abs((a & 127) - (b & 127)) <= 3)


def similar(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` shingles with ``inter`` in common reach the threshold."""
    return inter * LEAST[1] >= LEAST[0] * (a + b - inter)


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, size, fps) of every row with an id; wordless texts have no fingerprints."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in slices(batches, 256):
            texts = bytes_of(batch.column(1)).to_pylist()
            sets = shingle_sets(texts, SHINGLE, codes)
            size = np.diff(sets[1])
            fps = set_fingerprints(shingle_sets(texts, FEATURE, codes))[size > 0]
            ends = np.concatenate([[0], np.cumsum((size > 0) * VARIANTS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(fps.view(np.int64).ravel()))
            nodes = pa.array([set_node(s) for s in _split(sets)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array(size), lists], ["id", "node", "size", "fps"])
            if len(codes) > CODES:
                codes.clear()

    named = docs.filter(docs[id_col].isNotNull())
    shape = f"id {id_type}, node bigint, size bigint, fps array<bigint>"
    return named.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(mark, shape)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, mark) of all segments of nodes (node, size, fps)."""
    for batch in slices(batches, 4096):
        node, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fps = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, VARIANTS)
        full = np.flatnonzero(size > 0)
        if len(full):
            place, key, mark = key_marks(fps, size[full])
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(node[full][place]), pa.array(mark)], ["key", "node", "mark"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Batches sorted by their first column, (key, node, more), cut so that runs of a key stay whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[0].column(0)[0].as_py() != key[0]):
            if cut:
                yield from _columns([*held, batch.slice(0, cut)])
            else:
                yield from _columns(held)
            held = [batch.slice(cut)]
        elif cut:
            yield from _columns([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from _columns(held)


def _columns(held: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    table = pa.Table.from_batches(held).combine_chunks()
    yield table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks()


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return cuts, np.diff(np.concatenate([cuts, [len(key)]]))


def _near_any(mark: np.ndarray) -> np.ndarray:
    """Whether each mark of one bucket has a candidate in it."""
    out = np.zeros(len(mark), bool)
    for a in range(0, len(mark), 256):
        part = mark[a : a + 256]
        near = candidates(part[:, None], mark[None, :])
        near[np.arange(len(part)), np.arange(a, a + len(part))] = False
        out[a : a + 256] = near.any(1)
    return out


def cluster_pairs(key: np.ndarray, mark: np.ndarray, golay: Golay, pair_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: candidate pairs (a, b) of small clusters, and the first row of its cluster for every row of a large one, else -1."""
    run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    alone = np.bincount(run)[run] == 1
    place, index = golay.indices(mark >> 32)
    kept = ~alone[place]
    place, met = place[kept], run[place[kept]] << 12 | index[kept]
    order = np.argsort(met, kind="stable")
    place, met = place[order], met[order]
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, np.full(len(key), -1)
    cuts, size = _cuts(met)
    many = np.repeat(size, size)
    left, right = [none], [none]
    for step in range(1, pair_rows):
        at = np.flatnonzero((many > step) & (many <= pair_rows))
        at = at[at + step < len(met)]
        at = at[met[at] == met[at + step]]
        if not len(at):
            break
        at = at[candidates(mark[place[at]], mark[place[at + step]])]
        left.append(place[at])
        right.append(place[at + step])
    a, b = np.concatenate(left), np.concatenate(right)
    # All of a large bucket that have a candidate are one cluster.
    tied, wide = [], np.zeros(len(key), bool)
    for c, n in zip(cuts[size > pair_rows], size[size > pair_rows]):
        part = place[c : c + n]
        part = part[_near_any(mark[part])]
        wide[part] = True
        tied.append(np.stack([np.full(len(part), part[0]), part]) if len(part) else np.zeros((2, 0), np.int64))
    ends = np.concatenate([np.stack([a, b]), *tied], axis=1)
    root = lowest(ends[0], ends[1], len(key))
    large = np.bincount(root, minlength=len(key)) > pair_rows
    large[root[wide]] = True
    small = ~large[root[a]]
    pairs = np.unique(a[small] * len(key) + b[small])
    return pairs // len(key), pairs % len(key), np.where(large[root], root, -1)


def _meet(pair_rows: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (null, a, b) of small clusters; the nodes (cluster, a, null) of large ones."""
        golay = Golay()
        for key, node, more in _runs(batches):
            key = key.astype(np.int64)
            left, right, root = cluster_pairs(key, more.to_numpy(), golay, pair_rows)
            a, b = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])
            held = np.flatnonzero(root >= 0)
            # A cluster is named by its key and the place of its first row in the key's run.
            name = key[held] << 40 | (root[held] - np.searchsorted(key, key[held]))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(node[held]), pa.nulls(len(held), pa.int64())], ["key", "a", "b"])

    return meet


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set of a, set of b) the pairs that reach the threshold."""
    for batch in batches:
        left, right = (bytes_of(batch.column(i)).to_pylist() for i in (2, 3))
        hit = []
        for x, y in zip(left, right):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            near = similar(min(len(s), len(t)), len(s), len(t))
            hit.append(bool(near and similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(hit, pa.bool_())) for i in (0, 1)], ["a", "b"])


def forest(sets: list[np.ndarray], node: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one bucket, breadth first: each found node leaves the search."""
    count = np.array([len(s) for s in sets], dtype=np.int64)
    flat, starts = np.concatenate(sets), np.cumsum(count) - count
    rest, links = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own = sets[at]
            near = rest[similar(np.minimum(count[rest], count[at]), count[rest], count[at])]
            if not len(near):
                continue
            first = np.cumsum(count[near]) - count[near]
            other = flat[np.repeat(starts[near] - first, count[near]) + np.arange(count[near].sum())]
            place = np.searchsorted(own, other)
            place[place == len(own)] = 0
            inter = np.add.reduceat(own[place] == other, first, dtype=np.int64)
            found = near[similar(inter, count[near], count[at])]
            links += [(node[at], node[k]) for k in found]
            queue += found.tolist()
            rest = rest[~np.isin(rest, found)]
    return links


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, node, more in _runs(batches):
        held = bytes_of(more)
        for cut, n in zip(*_cuts(key)):
            links = forest([np.frombuffer(s.as_py(), np.uint64) for s in held.slice(cut, n)], node[cut : cut + n])
            a, b = (np.array(x, dtype=np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _links(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, pair_rows: int) -> DataFrame:
    """Verified links (a, b) between nodes that connect all that candidates connect."""
    nodes = marks.groupBy("node").agg(F.first("size").alias("size"), F.first("fps").alias("fps"))
    keys = nodes.select("node", "size", "fps").mapInArrow(_keyed, "key int, node bigint, mark bigint")
    keys = keys.repartition("key").sortWithinPartitions("key", "node")
    met = pinned(keys.mapInArrow(_meet(pair_rows), "key bigint, a bigint, b bigint"))
    pairs = pinned(met.filter("b IS NOT NULL").select("a", "b").distinct())
    large = met.filter("b IS NULL").select("key", F.col("a").alias("node"))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    firsts = marks.groupBy("node").agg(F.min("id").alias("id"))
    asked = lookup(firsts.join(needed, "node", "left_semi").select(F.col("id").alias("_id"), F.col("node").alias("_node")))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = _split(shingle_sets(bytes_of(batch.column(1)).to_pylist(), SHINGLE))
            kept = [k for k, (s, n) in enumerate(zip(sets, batch.column(0).to_pylist())) if set_node(s) == n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array([sets[k].tobytes() for k in kept], pa.binary())], ["node", "held"]
            )

    texts = docs.join(asked, docs[id_col] == asked["_id"]).select(asked["_node"], docs[text_col].alias("text"))
    sets = texts.mapInArrow(fill, "node bigint, held binary")
    # Rows that repeat an id with one set would repeat its node.
    sets = pinned(sets if marks.groupBy("id").count().filter("count > 1").isEmpty() else sets.dropDuplicates(["node"]))
    side = lambda n: sets.select(F.col("node").alias(n), F.col("held").alias(f"_{n}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b").mapInArrow(_verify, "a bigint, b bigint")
    if large.isEmpty():
        return links
    held = large.join(sets, "node").select("key", "node", "held").repartition("key").sortWithinPartitions("key", "node")
    return links.unionByName(held.mapInArrow(_forests, "a bigint, b bigint").distinct())


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair_rows: int = PAIR_ROWS) -> DataFrame:
    """One row of every group that verified links connect, that of the smallest id, with all columns."""
    marks = pinned(_marks(docs, id_col, text_col))
    roots = connected_components(_links(docs, marks, id_col, text_col, pair_rows)).select(F.col("node").alias("_n"), "root")
    rows = pinned(marks.select("id", "node").join(lookup(roots), F.col("node") == F.col("_n"), "left").select("id", "node", F.coalesce("root", "node").alias("root")))
    kept = pinned(rows.groupBy("root").agg(F.min(F.struct("id", "node")).alias("first")).select("root", F.col("first.id").alias("_keep"), F.col("first.node").alias("_kept")))
    again = lookup(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_again")))
    # Those that go are fewer than those that stay, so the texts seldom have to be shuffled.
    going = rows.join(kept, "root").filter((F.col("id") != F.col("_keep")) | (F.col("node") != F.col("_kept"))).select(F.col("id").alias("_gone")).distinct()
    if again.isEmpty():
        gone = lookup(going)
        return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    gone = lookup(going.union(again).distinct())
    staying = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    # A name that no column of the rows has.
    own = "_" * (max(map(len, docs.columns)) + 1)
    shape = StructType([*docs.schema.fields, StructField(own, LongType())])
    text = docs.columns.index(text_col)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            node = [set_node(s) for s in _split(shingle_sets(bytes_of(batch.column(text)).to_pylist(), SHINGLE))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, own])

    told = docs.join(again, docs[id_col] == again["_again"], "left_semi").mapInArrow(tell, shape)
    told = told.join(kept, (told[id_col] == kept["_keep"]) & (told[own] == kept["_kept"]), "left_semi")
    return staying.unionByName(told.dropDuplicates([id_col, own]).drop(own))
