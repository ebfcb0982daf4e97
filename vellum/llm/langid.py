"""Language identification with word-first backoff.

A word that the model knows adds its log frequency under each language. An unseen word
falls back to its character 4-grams, and where none of them is known to 3-grams, 2-grams
and single characters; the known n-grams of the first length that has any add their mean
log frequency. The sums' softmax gives the language and its score.

The model is learned from a bounded sample of labelled texts, ``sample_rows`` rows and
``sample_bytes`` bytes for each language, and keeps every word and n-gram of it.

Defined cases: a null text, one without letters, and any text when nothing was learned,
gives ``und`` with score 0; rows without a label are never learned from; rows without an
id are sampled by their texts; repeated rows are predicted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, slices

#: Labelled texts, and their bytes, that are learned from for each language.
SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 4_000_000
GRAM = 4
SEED = 17
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; numerals such as a half or a Roman twelve are none."""
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for found in words for w in "".join(c if c.isalpha() else " " for c in found).split()]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its edges; single characters have no edges."""
    held = f" {word} " if n > 1 else word
    return [held[i : i + n] for i in range(len(held) - n + 1)]


class Model:
    """Log-frequency tables: rows are words, or n-grams of each length, columns languages."""

    def __init__(self, langs: list[str], counts: dict[int, dict[str, list[int]]]) -> None:
        """``counts[0]`` has word counts by language, ``counts[n]`` those of n-grams."""
        self.langs = langs
        self.places, self.tables = {}, {}
        for n, units in counts.items():
            self.places[n] = {u: i for i, u in enumerate(units)}
            c = np.array(list(units.values()), dtype=np.float64).reshape(len(units), len(langs))
            self.tables[n] = np.log((c + 0.5) / (c.sum(0) + 0.5 * (len(units) + 1)))

    @classmethod
    def of(cls, words: list[str], langs: list[str], numbers: list[int]) -> Model:
        """From counts of words by language; n-grams count as often as their words."""
        names = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(names)}
        counts: dict[int, dict[str, list[int]]] = {k: {} for k in range(GRAM + 1)}
        for word, lang, n in zip(words, langs, numbers):
            at = place[lang]
            counts[0].setdefault(word, [0] * len(names))[at] += n
            for k in range(1, GRAM + 1):
                held = counts[k]
                for g in grams_of(word, k):
                    held.setdefault(g, [0] * len(names))[at] += n
        return cls(names, counts)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Backed-off log scores of words that the model does not know."""
        out = np.zeros((len(words), len(self.langs)))
        rest = list(range(len(words)))
        for n in range(GRAM, 0, -1):
            get = self.places.get(n, {}).get
            rows, sizes, left, done = [], [], [], []
            for i in rest:
                known = [k for k in map(get, grams_of(words[i], n)) if k is not None]
                if known:
                    rows += known
                    sizes.append(len(known))
                    done.append(i)
                else:
                    left.append(i)
            if done:
                size = np.array(sizes)
                starts = np.cumsum(size) - size
                out[done] = np.add.reduceat(self.tables[n][rows], starts, axis=0) / size[:, None]
            rest = left
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = self.places.get(0, {})
        fresh: dict[str, int] = {}
        ids: list[int] = []
        sizes = []
        for text in texts:
            words = words_of(text) if text and self.langs else []
            sizes.append(len(words))
            for w in words:
                i = known.get(w)
                ids.append(i if i is not None else len(known) + fresh.setdefault(w, len(fresh)))
        size = np.array(sizes, dtype=np.int64)
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        full = np.flatnonzero(size)
        if len(full):
            table = np.concatenate([self.tables[0], self.unseen(list(fresh))]) if fresh else self.tables[0]
            starts = np.cumsum(size[full]) - size[full]
            total = np.add.reduceat(table[np.array(ids, dtype=np.int64)], starts, axis=0)
            share = np.exp(total - total.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            scores[full] = share[np.arange(len(full)), best]
            for i, b in zip(full, best):
                langs[i] = self.langs[b]
        return langs, scores


def learn(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Count units per language on the executors; the counts, as bounded as the sample, reach the driver."""
    usable = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    sample = bounded_sample(usable, ["id", "text"], sample_rows, sample_bytes, SEED, text="text", by="lang").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in kept.items() for w, n in c.items()]
            cols = list(zip(*rows)) or [(), (), ()]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

        for batch in slices(batches, 256):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, kept.values())) > 100_000:
                yield out()
        yield out()

    counted = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    return Model.of(counted["word"].to_pylist(), counted["lang"].to_pylist(), counted["n"].to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            langs, scores = sent.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        predict, f"id {id_type}, lang_pred string, score double"
    )
