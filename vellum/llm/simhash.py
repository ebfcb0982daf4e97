"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint has four 16-bit segments. With at most three differing bits one
segment is equal in both, and it can be chosen so that the 23 bits after it hold at
most two of them. Those 23 bits are decoded to codewords of the perfect (23, 12) Golay
code: the one within distance three, and, for words at distance three, also the five at
distance four. Any two words at most two bits apart share one of these up to six
indices, so equal segment plus index is a key that every linked pair shares: a hash
join on it, verified by counting bits, finds all links.

A bucket yields one link a row, to the first of the rows that its verified links connect
with it, not its pairs. A bucket too
large for one task goes another exact way: fingerprints meet at points one bit from one
and at most two bits from the other.

Defined cases: a null or wordless text has fingerprint zero and links like any other;
a row without an id gets its fingerprint but no component; repeated rows are returned
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, lookup, lower_words, pinned, slices
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Distinct fingerprints that one bucket may bring into one task.
BUCKET_ROWS = 32_768
#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = lower_words(text)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    digest = xxhash.xxh64_intdigest
    return [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(size))))]


def remixed(h: np.ndarray, variant: int) -> np.ndarray:
    """Another well-spread hash of the same shingles; variant 0 is the hash itself."""
    if variant:
        h = (h ^ np.uint64(variant * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def majority(flat: np.ndarray, counts: np.ndarray, width: int = 64) -> np.ndarray:
    """The bits that over half the hashes of each text set; ``flat`` has the hashes text by text.

    Hashes stand in blocks of ``width``, filled up with zeros, and are added as columns of
    bits: numbers of k bits are k words, so one addition of words adds 64 counters.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    held = counts[full]
    blocks = -(-held // width)
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * width, dtype=np.uint64)
    padded[np.arange(len(flat)) + np.repeat(first * width - (np.cumsum(held) - held), held)] = flat
    planes = [padded.reshape(-1, width)]
    while planes[0].shape[1] > 1:
        carry, added = np.uint64(0), []
        for p in planes:
            a, b = p[:, ::2], p[:, 1::2]
            odd = a ^ b
            added.append(odd ^ carry)
            carry = (a & b) | (carry & odd)
        planes = [*added, carry]
    ones = np.zeros((len(planes[0]), 64), dtype=np.int64)
    for k, p in enumerate(planes):
        ones += np.unpackbits(np.ascontiguousarray(p).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) << k
    ones = np.add.reduceat(ones, first, axis=0)
    out[full] = np.packbits(ones * 2 > held[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Majority bits of the shingle hashes of each text, as uint64."""
    hashes = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    return majority(np.array([h for hs in hashes for h in hs], dtype=np.uint64), counts)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            fp = fingerprints(bytes_of(batch.column(1)).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(mark, f"id {id_type}, fp bigint")


class Golay:
    """Codeword indices near 23-bit words, by syndrome tables made from the generator."""

    def __init__(self) -> None:
        unit = [self._remainder(1 << i) for i in range(23)]
        self.parts = []
        for low in (0, 8, 16):
            table = np.zeros(256, dtype=np.int64)
            for v in range(256):
                for i in range(8):
                    if v >> i & 1 and low + i < 23:
                        table[v] ^= unit[low + i]
            self.parts.append(table)
        self.near = np.full(2048, -1, dtype=np.int64)
        self.weight = np.zeros(2048, dtype=np.int64)
        for w in range(4):
            for error in combinations(range(23), w):
                s = self._sum(unit, error)
                self.near[s], self.weight[s] = sum(1 << i for i in error), w
        far: list[list[int]] = [[] for _ in range(2048)]
        for error in combinations(range(23), 4):
            far[self._sum(unit, error)].append(sum(1 << i for i in error))
        self.far = np.array([f[:5] if self.weight[s] == 3 else [0] * 5 for s, f in enumerate(far)], dtype=np.int64)

    @staticmethod
    def _remainder(x: int) -> int:
        while x.bit_length() > 11:
            x ^= _GENERATOR << (x.bit_length() - 12)
        return x

    @staticmethod
    def _sum(unit: list[int], error: tuple[int, ...]) -> int:
        s = 0
        for i in error:
            s ^= unit[i]
        return s

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, codeword index): one or six per word."""
        s = self.parts[0][words & 255] ^ self.parts[1][words >> 8 & 255] ^ self.parts[2][words >> 16]
        first = (words ^ self.near[s]) >> 11
        wide = np.flatnonzero(self.weight[s] == 3)
        more = (words[wide, None] ^ self.far[s[wide]]) >> 11
        place = np.concatenate([np.arange(len(words)), np.repeat(wide, 5)])
        return place, np.concatenate([first, more.ravel()])


def bucket_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``fp``, key) over the four choices of the equal segment."""
    places, keys = [], []
    for i in range(4):
        turn = 16 * (i + 1) % 64
        after = fp if turn == 0 else (fp >> np.uint64(turn)) | (fp << np.uint64(64 - turn))
        place, index = golay.indices((after & np.uint64(0x7FFFFF)).astype(np.int64))
        equal = (fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64)
        places.append(place)
        keys.append((i << 28) | (equal[place] << 12) | index)
    return np.concatenate(places), np.concatenate(keys)


def _forest(fp: np.ndarray, node: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of one bucket, breadth first: each found row leaves the search."""
    rest = np.arange(len(fp))
    links = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = np.bitwise_count(fp[rest] ^ fp[at]) <= bits
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                links += [(node[at], node[k]) for k in found]
                queue += found.tolist()
    return links


def lowest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n places that links (left, right) connect with each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        if (root[left] == low).all() and (root[right] == low).all():
            return root
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]


def bucket_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of every row to the first of its component inside a run of equal keys: at most one a row.

    Rows are ordered by node in a run, so that the trees of different buckets share their roots.
    """
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([cuts, [len(key)]]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    run = np.repeat(size, size)
    for step in range(1, 16):
        first = np.flatnonzero((run > step) & (run <= 16))
        first = first[first + step < len(key)]
        first = first[key[first] == key[first + step]]
        hit = first[np.bitwise_count(fp[first] ^ fp[first + step]) <= bits]
        a.append(hit)
        b.append(hit + step)
    for c, n in zip(cuts[size > 16], size[size > 16]):
        links = _forest(fp[c : c + n], np.arange(c, c + n), bits)
        if links:
            x, y = zip(*links)
            a.append(np.array(x))
            b.append(np.array(y))
    root = lowest(np.concatenate(a), np.concatenate(b), len(key))
    moved = np.flatnonzero(root != np.arange(len(key)))
    return node[root[moved]], node[moved]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[cut:] for c in cols]
        if cut:
            yield _as_links(*[c[:cut] for c in cols])
    if held is not None:
        yield _as_links(*held)


def _as_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    a, b = bucket_links(key, fp.view(np.uint64), node)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].astype(np.int64))], ["a", "b"])


def _meeting_points(rows: DataFrame) -> DataFrame:
    """Links among the rows of oversized buckets: (a, b).

    Every row goes to all points within two bits of it. Rows within one bit of a point
    are at most two bits apart, and at most three from the others there; all link to
    the smallest of the former. Any pair within three bits meets at such a point.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
        ring = np.array([0] + [1] * 64 + [2] * (len(flips) - 65), dtype=np.int32)
        mask = np.array(flips, dtype=np.uint64)
        for batch in slices(batches, 64):
            fp, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = (fp[:, None] ^ mask[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(node, len(mask))), pa.array(np.tile(ring, len(fp)))], ["at", "node", "ring"])

    points = pinned(rows.select("fp", "node").mapInArrow(spread, "at bigint, node bigint, ring int"))
    hubs = pinned(points.filter("ring <= 1").groupBy(F.col("at").alias("_at")).agg(F.min("node").alias("b")))
    return points.join(hubs, F.col("at") == F.col("_at")).select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def fingerprint_links(marks: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between nodes of ``marks`` (fp, node), distinct fingerprints, at most three bits apart.

    Enough links are returned to connect all that are connected.
    """
    golay = Golay()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fp, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place, key = bucket_keys(fp.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[place]), pa.array(node[place])], ["key", "fp", "node"])

    keys = marks.select("fp", "node").mapInArrow(keyed, "key bigint, fp bigint, node bigint")
    # A bucket lies inside the rows of one equal segment, whose counts are few and cheap.
    parts = F.array(*[(F.lit(i << 16) + F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("long") for i in range(4)])
    crowded = marks.select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("part")
    apart = None
    if not crowded.isEmpty():
        inside = keys.join(lookup(crowded), F.shiftright("key", 12) == F.col("part"), "left_semi")
        over = lookup(inside.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("_k"))
        if not over.isEmpty():
            apart = _meeting_points(keys.join(over, F.col("key") == F.col("_k"), "left_semi").select("fp", "node").distinct())
            keys = keys.join(over, F.col("key") == F.col("_k"), "left_anti")
    links = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_link_batches, "a bigint, b bigint")
    return links if apart is None else links.unionByName(apart)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp, component) of every row; component is the smallest id reachable over links."""
    rows = pinned(fingerprint_table(docs, id_col, text_col, size))
    marks = pinned(rows.filter(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("node")))
    links = fingerprint_links(marks, bucket_rows)
    roots = lookup(connected_components(links).withColumnRenamed("node", "_node"))
    classes = pinned(marks.join(roots, F.col("node") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("component")))
    return rows.join(classes, F.col("fp") == F.col("_fp"), "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
