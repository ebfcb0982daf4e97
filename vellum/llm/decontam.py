"""Benchmark decontamination by spaced-seed hashing.

Benchmark and training texts are folded to words (letters and digits; A-Z in lower
case). Four masks look at four of up to five adjacent words each, so a replaced word
does not hide its neighbours. Hashes of the masked words of both sides are joined; each
hit fixes an alignment, along which words are compared one by one: a passage leaks where
four fifths of its aligned words agree, over the whole item or over a long stretch.

The benchmark enters in blocks of bounded size, each a hash table held against all
documents, so the join needs no shuffle of the documents; there is one scan for each block,
and one block at a time on the driver. Hits are expanded and verified ``HITS`` at a time,
so a passage that many items share takes time but no memory.

Defined cases: a null text has no words; an item of fewer words than a mask spans is found
where all its words stand in a row, one of no words nowhere; repeated rows and equal items
are reported each; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, pinned, shared_path, slices

#: Offsets that each mask reads.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SPAN = 5
#: Least share of equal words, and length in words of a stretch that counts by itself.
SIMILARITY = 0.8
STRETCH = 12
#: Characters of benchmark text that one block holds.
BLOCK_CHARS = 8_000_000
#: Pairs of a place and an item that are verified at a time.
HITS = 500_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _mix(n: int, seed: int) -> np.ndarray:
    """n well-spread odd 64-bit numbers (a Weyl sequence through a mixer)."""
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


class SeedIndex:
    """Masked hashes of a block of items, and the search of documents against them."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        vocab: dict[bytes, int] = {}
        self.ids, words = [], []
        for item, text in items:
            found = folded_words(text or b"")
            if found:
                self.ids.append(item)
                words.append([vocab.setdefault(w, len(vocab) + 1) for w in found])
        self.vocab = vocab
        self.codes = _mix(len(vocab) + 1, 11)
        # Short items have masks of all their words, which no longer item takes.
        self.masks = [(mask, SPAN, None) for mask in MASKS] + [(tuple(range(n)), n, n) for n in range(1, SPAN)]
        self.factors = [_mix(SPAN, 1000 + m) for m in range(len(self.masks))]
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.words = np.array([x for w in words for x in w], dtype=np.int64)
        self.tables = []
        items, places, base = [], [], 0
        for m, (mask, least, most) in enumerate(self.masks):
            span = mask[-1] + 1
            h = self._hashes(self.words, m)
            item = np.repeat(np.arange(len(words)), self.length)[: len(h)]
            place = np.arange(len(h)) - self.start[item] if len(h) else np.zeros(0, np.int64)
            size = self.length[item]
            inside = (place + span <= size) & (size >= least) & (size <= (most or size))
            h, item, place = h[inside], item[inside], place[inside]
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[h >> np.uint64(44)] = True
            self.tables.append((h[order], base, sieve))
            items.append(item[order])
            places.append(place[order])
            base += len(h)
        self.items, self.places = np.concatenate(items), np.concatenate(places)

    def _hashes(self, words: np.ndarray, m: int) -> np.ndarray:
        mask, factors = self.masks[m][0], self.factors[m]
        n = len(words) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.uint64)
        codes = self.codes[words]
        h = np.zeros(n, dtype=np.uint64)
        for at, factor in zip(mask, factors):
            h += codes[at : at + n] * factor
        return h ^ (h >> np.uint64(29))

    def search(self, texts: list[bytes]) -> np.ndarray:
        """Rows (text, item, start, length, equal): the best alignment of each leaking item in each text."""
        none = np.zeros((0, 5), dtype=np.int64)
        if not len(self.ids):
            return none
        get = self.vocab.get
        words: list[int] = []
        start, stop = [], []
        gap = [0] * SPAN
        for text in texts:
            start.append(len(words))
            words += [get(w, 0) for w in folded_words(text)]
            stop.append(len(words))
            words += gap
        flat = np.array(words, dtype=np.int64)
        begin, end = np.array(start, dtype=np.int64), np.array(stop, dtype=np.int64)
        spots, firsts, counts = [], [], []
        for m, (hashes, base, sieve) in enumerate(self.tables):
            h = self._hashes(flat, m)
            at = np.flatnonzero(sieve[h >> np.uint64(44)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            hit = high > low
            spots.append(at[hit])
            firsts.append(base + low[hit])
            counts.append((high - low)[hit])
        spot, first, many = (np.concatenate(x) for x in (spots, firsts, counts))
        order = np.argsort(spot, kind="stable")
        spot, first, many = spot[order], first[order], many[order]
        ends = np.cumsum(many)
        total, best = int(ends[-1]) if len(ends) else 0, none
        # In the order of places, so that the hits of one alignment come together; a place of many items comes in parts.
        for a in range(0, total, HITS):
            pair = np.arange(a, min(a + HITS, total))
            own = np.searchsorted(ends, pair, "right")
            k = first[own] + pair - (ends[own] - many[own])
            at = spot[own]
            text, item, shift = np.unique(np.stack([np.searchsorted(begin, at, "right") - 1, self.items[k], at - self.places[k]]), axis=1)
            best = self._best(np.concatenate([best, self._verify(flat, begin, end, text, item, shift)]))
        return best

    @staticmethod
    def _best(held: np.ndarray) -> np.ndarray:
        """Of rows (text, item, start, length, equal) the best of each text and item."""
        order = np.lexsort((held[:, 2], -held[:, 4], held[:, 1], held[:, 0]))
        held = held[order]
        first = np.ones(len(held), bool)
        first[1:] = (held[1:, :2] != held[:-1, :2]).any(axis=1)
        return held[first]

    def _verify(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        out = []
        step = max(1, 4_000_000 // int(self.length.max()))
        for a in range(0, len(item), step):
            t, i, s = text[a : a + step], item[a : a + step], shift[a : a + step]
            n = self.length[i]
            # Stretches score 1 for an equal word and -4 for another: 0 or more means four
            # fifths agree. The best one of the least length comes from the smallest earlier
            # prefix sum; words outside the text count as far below.
            least = np.minimum(STRETCH, n)
            wide = int(n.max())
            sums = np.zeros((wide + 1, len(i)), np.int64)
            equal = np.zeros((wide + 1, len(i)), np.int64)
            low, low_at = np.full(len(i), 1 << 40), np.zeros(len(i), np.int64)
            best, best_at, best_to = np.full(len(i), -1), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            every = np.arange(len(i))
            for j in range(wide):
                at = s + j
                inside = (j < n) & (at >= begin[t]) & (at < end[t])
                same = inside & (flat[np.where(inside, at, 0)] == self.words[np.where(j < n, self.start[i] + j, 0)])
                sums[j + 1] = sums[j] + np.where(same, 1, np.where(inside, -4, -(1 << 30)))
                equal[j + 1] = equal[j] + same
                from_at = j + 1 - least
                there = sums[np.maximum(from_at, 0), every]
                lower = (from_at >= 0) & (there < low)
                low, low_at = np.where(lower, there, low), np.where(lower, from_at, low_at)
                more = (from_at >= 0) & (j < n) & (sums[j + 1] - low > best)
                best, best_at, best_to = np.where(more, sums[j + 1] - low, best), np.where(more, low_at, best_at), np.where(more, j + 1, best_to)
            whole = equal[n, every] >= np.ceil(SIMILARITY * n - 1e-9)
            part = best >= 0
            first = np.maximum(np.where(whole, s, s + best_at), begin[t])
            last = np.minimum(np.where(whole, s + n, s + best_to), end[t])
            agreed = np.where(whole, equal[n, every], equal[best_to, every] - equal[best_at, every])
            kept = np.stack([t, i, first - begin[t], last - first, agreed], axis=1)
            out.append(kept[whole | part])
        return np.concatenate(out)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[SeedIndex]:
    """One index per block of about ``block_chars`` characters of items, one at a time."""
    items = pinned(benchmark.select(benchmark[item_col].alias("item"), benchmark[text_col].alias("text")).filter(F.col("text").isNotNull()))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        rows = items.filter(block == b).orderBy("item", "text").collect()
        yield SeedIndex([(r["item"], r["text"].encode()) for r in rows])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item that leaks into it: id, item, start, words, equal, similarity.

    ``start`` counts the document's folded words from 0.
    """
    spark: SparkSession = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, start bigint, words bigint, equal bigint"
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = None
    for index in _blocks(benchmark, item_col, item_text_col, block_chars):
        if found is not None:
            # What earlier blocks have found is stored, so that they need not stay in memory.
            found = pinned(found)
        part = source.mapInArrow(_searcher(spark, index), schema)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.withColumn("similarity", F.col("equal") / F.col("words"))


def _searcher(spark: SparkSession, index: SeedIndex):
    sent = spark.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in slices(batches, 512):
            hits = index.search(bytes_of(batch.column(1)).to_pylist())
            ids = pa.array([index.ids[i] for i in hits[:, 1]], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hits[:, 0])), ids, *(pa.array(hits[:, c]) for c in (2, 3, 4))], ["id", "item", "start", "words", "equal"]
            )

    return search


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all columns."""
    spark = docs.sparkSession
    kept = docs
    for number, index in enumerate(_blocks(benchmark, item_col, item_text_col, block_chars)):
        if number:
            path = shared_path(spark, "clean")
            kept.write.parquet(path)
            kept = spark.read.schema(docs.schema).parquet(path)
        sent = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 512):
                hits = sent.value.search(bytes_of(batch.column(batch.schema.get_field_index(text_col))).to_pylist())
                stay = np.ones(batch.num_rows, dtype=bool)
                stay[hits[:, 0]] = False
                yield batch.filter(pa.array(stay))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
