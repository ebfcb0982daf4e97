"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Texts are folded to words. Every word enters with a learned word vector and the mean of
learned vectors of its character 3- to 5-grams, so unseen forms of a known stem are
recognised. All vectors start at random: log-odds of words only choose the vocabulary and
the windows of the first round. Two gated recurrent layers read a window of ``WINDOW`` words forwards and backwards, attention pools their states
to a logit, and a text scores the highest of all its overlapping windows.

The network is trained in numpy on a bounded sample of labelled texts, ``sample_rows``
rows and ``sample_bytes`` bytes of each class. A label holds for a text, not for its windows, so every round takes the
highest-scoring window of each toxic text, and the highest and a random one of others.

Defined cases: a null or wordless text is scored as one empty word; without labelled
texts of both classes every score is the share of toxic ones (0 if there are none);
repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, lookup, pinned, slices

#: Labelled texts, and their bytes, that are learned from for each class.
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 16_000_000
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
MAX_WORDS = 20_000
BUCKETS = 1 << 16
ROUNDS, PASSES, BATCH, RATE = 4, 4, 128, 0.01
#: A round makes at least this many steps, however few texts there are.
MIN_STEPS = 120
SEED = 23
#: Weight of the class shares in a unit's log-odds, in texts.
PRIOR = 10.0
#: Log-odds up to which a unit says nothing.
WEAK = 0.8
#: Bytes that words are made of: letters, digits and all beyond ASCII.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split() or [b""]


def char_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the words with their edges, and the word of each."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    out, of = [], []
    for n in (3, 4, 5):
        if len(data) < n:
            break
        h = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(23)
        inside = left[: len(h)] >= n
        out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))[inside].astype(np.int64) % BUCKETS)
        of.append(word[: len(h)][inside])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, of_word = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    return grams[order], of_word[order]


def windows_of(n: int) -> list[int]:
    """Starts of the windows that cover n words; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, training pass and scoring pass. Layers: 0 reads forwards, 1 backwards."""

    def __init__(self, vocab: dict[bytes, int], rng: np.random.Generator) -> None:
        e, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        self.vocab = vocab
        self.p = {"word": small(len(vocab) + 1, WORD_DIM) * 0.1, "gram": small(BUCKETS, CHAR_DIM) * 0.1, "v": small(2 * h), "u": small(2 * h), "c": np.full(1, -1, np.float32)}
        self.p["word"][0] = 0
        for d in (0, 1):
            self.p |= {f"w{d}": small(e, 3 * h) * 2, f"b{d}": np.zeros(3 * h, np.float32), f"r{d}": small(h, 3 * h) * 2}

    def inputs(self, words: np.ndarray, grams: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of n words with vocabulary places ``words``; and their gram counts."""
        count = np.bincount(of, minlength=n).astype(np.float32)
        x = np.zeros((n, WORD_DIM + CHAR_DIM), dtype=np.float32)
        x[:, :WORD_DIM] = self.p["word"][words]
        if len(grams):
            full = np.flatnonzero(count)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            x[full, WORD_DIM:] = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / count[full, None]
        return x, count

    def table(self, words: list[bytes], known: bool) -> np.ndarray:
        """Input vectors of distinct words, made in bounded pieces."""
        out = []
        for a in range(0, len(words), 16_384):
            part = words[a : a + 16_384]
            place = np.array([self.vocab.get(w, 0) for w in part], dtype=np.int64) if known else np.zeros(len(part), np.int64)
            out.append(self.inputs(place, *char_buckets(part), len(part))[0])
        return np.concatenate(out) if out else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)

    def step(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss over windows (rows of ``idx`` into ``x``), and x's gradient."""
        p, h, (b, t) = self.p, HIDDEN, idx.shape
        states = np.zeros((b, t, 2 * h), np.float32)
        kept = []
        for d in (0, 1):
            proj = (x @ p[f"w{d}"] + p[f"b{d}"])[idx]
            state, log = np.zeros((b, h), np.float32), {}
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                q = state @ p[f"r{d}"]
                gates = _sigmoid(proj[:, k, : 2 * h] + q[:, : 2 * h])
                r, z = gates[:, :h], gates[:, h:]
                n = np.tanh(proj[:, k, 2 * h :] + r * q[:, 2 * h :])
                m = mask[:, k, None]
                log[k] = (state, r, z, n, q[:, 2 * h :], m)
                state = m * ((1 - z) * n + z * state) + (1 - m) * state
                states[:, k, d * h : (d + 1) * h] = state
            kept.append(log)
        focus = np.where(mask > 0, states @ p["v"], -1e9)
        weight = np.exp(focus - focus.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        value = states @ p["u"]
        logit = (weight * value).sum(1) + p["c"][0]
        d_logit = ((_sigmoid(logit) - label) / b).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        d_value = weight * d_logit[:, None]
        d_weight = value * d_logit[:, None]
        d_focus = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_states = d_focus[:, :, None] * p["v"] + d_value[:, :, None] * p["u"]
        g["v"] = np.einsum("bt,bth->h", d_focus, states)
        g["u"] = np.einsum("bt,bth->h", d_value, states)
        g["c"] = np.array([d_logit.sum()], np.float32)
        dx = np.zeros_like(x)
        for d in (0, 1):
            d_proj, d_state = np.zeros((b, t, 3 * h), np.float32), np.zeros((b, h), np.float32)
            for k in range(t - 1, -1, -1) if d == 0 else range(t):
                before, r, z, n, q3, m = kept[d][k]
                d_state = d_state + d_states[:, k, d * h : (d + 1) * h]
                new = d_state * m
                dn = new * (1 - z) * (1 - n * n)
                dz = new * (before - n) * z * (1 - z)
                dr = dn * q3 * r * (1 - r)
                dq = np.concatenate([dr, dz, dn * r], axis=1)
                d_proj[:, k] = np.concatenate([dr, dz, dn], axis=1)
                g[f"r{d}"] += before.T @ dq
                d_state = d_state * (1 - m) + new * z + dq @ p[f"r{d}"].T
            flat = d_proj.reshape(b * t, 3 * h)
            g[f"w{d}"] = x[idx.ravel()].T @ flat
            g[f"b{d}"] = flat.sum(0)
            np.add.at(dx, idx.ravel(), flat @ p[f"w{d}"].T)
        return g, dx

    def logits(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows; ``idx`` is (words, windows), ``mask`` likewise or None if all are full."""
        p, h, (t, b) = self.p, HIDDEN, idx.shape
        focus, value = np.zeros((t, b), np.float32), np.zeros((t, b), np.float32)
        for d in (0, 1):
            proj = np.ascontiguousarray((x @ p[f"w{d}"] + p[f"b{d}"]).T)
            part = slice(d * h, (d + 1) * h)
            turn = np.ascontiguousarray(np.concatenate([p[f"r{d}"].T, p["v"][None, part], p["u"][None, part]]))
            state = np.zeros((h, b), np.float32)
            q = turn @ state
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                g = np.take(proj, idx[k], axis=1)
                gates = g[: 2 * h]
                gates += q[: 2 * h]
                np.negative(gates, out=gates)
                np.minimum(gates, 30, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                n = g[2 * h :]
                n += gates[:h] * q[2 * h : 3 * h]
                np.tanh(n, out=n)
                new = state - n
                new *= gates[h:]
                new += n
                state = new if mask is None else np.where(mask[k], new, state)
                q = turn @ state
                focus[k] += q[3 * h]
                value[k] += q[3 * h + 1]
        if mask is not None:
            focus[~mask] = -1e9
        focus -= focus.max(0)
        np.exp(focus, out=focus)
        return (focus * value).sum(0) / focus.sum(0) + p["c"][0]


class Words(dict):
    """Gives new words the next places beyond the known ones."""

    def __init__(self, known: dict[bytes, int]) -> None:
        super().__init__(known)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        place = self[word] = len(self)
        return place


class Model:
    """A trained network, or a constant where nothing could be learned."""

    def __init__(self, network: Network | None, constant: float = 0.0) -> None:
        self.network, self.constant = network, constant
        self.base: np.ndarray | None = None

    def _window_logits(self, x: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.float32)
        span = np.arange(WINDOW)[:, None]
        for full in (True, False):
            rows = np.flatnonzero((size >= WINDOW) == full)
            for a in range(0, len(rows), 4096):
                r = rows[a : a + 4096]
                mask = None if full else span < size[r][None, :]
                at = start[r][None, :] + (span if full else np.minimum(span, size[r][None, :] - 1))
                out[r] = self.network.logits(x, flat[at], mask)
        return out

    def score_windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, text and start of every window of the texts."""
        net = self.network
        if self.base is None:
            self.base = net.table([b"", *net.vocab], True)
        # Place 0 is the empty word, 1.. the vocabulary, as in the network's word table.
        known = Words({b"": 0, **net.vocab})
        ids: list[int] = []
        start, size, of = [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            for s in windows_of(len(words)):
                start.append(len(ids) + s)
                size.append(min(WINDOW, len(words)))
                of.append(i)
            ids += [known[w] for w in words]
        x = np.concatenate([self.base, net.table(known.fresh, False)])
        begin = np.array(start, dtype=np.int64)
        logits = self._window_logits(x, np.array(ids, dtype=np.int64), begin, np.array(size, dtype=np.int64))
        return logits, np.array(of, dtype=np.int64), begin

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.constant)
        logits, of, _ = self.score_windows(texts)
        best = np.maximum.reduceat(logits, np.searchsorted(of, np.arange(len(texts))))
        return _sigmoid(best.astype(np.float64))


def _odds(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Shrunken log-odds against the class shares; weak evidence counts as none."""
    raw = np.log((pos + PRIOR * share) / (neg + PRIOR * (1 - share)) * (1 - share) / share)
    return np.sign(raw) * np.maximum(np.abs(raw) - WEAK, 0)


def train(texts: list[str | None], labels: np.ndarray, seed: int = SEED, rounds: int = ROUNDS) -> Model:
    """Fit a network to texts with labels 0 and 1."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(None, share)
    rng = np.random.default_rng(seed)
    seen: dict[bytes, int] = {}
    ids = [np.array([seen.setdefault(w, len(seen)) for w in words_of(t)], dtype=np.int32) for t in texts]
    words = list(seen)
    # N-grams of all words, in pieces, as they outnumber the words by far.
    held, sizes = [], []
    for a in range(0, len(words), 16_384):
        part, of = char_buckets(words[a : a + 16_384])
        held.append(part.astype(np.int32))
        sizes.append(np.bincount(of, minlength=min(16_384, len(words) - a)))
    grams, first = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    del held, sizes, seen
    counts = np.zeros((2, len(words)))
    gram_counts = np.zeros((2, BUCKETS))
    for d, y in zip(ids, labels):
        u = np.unique(d)
        counts[y, u] += 1
        pieces = np.concatenate([grams[first[w] : first[w + 1]] for w in u])
        gram_counts[y, np.unique(pieces)] += 1
    odds = _odds(counts[1], counts[0], share)
    strength = np.abs(odds) * (counts.sum(0) >= 2)
    top = [int(i) for i in np.lexsort((np.arange(len(words)), -strength))[:MAX_WORDS] if strength[i] > 0]
    vocab = {words[i]: k + 1 for k, i in enumerate(top)}
    gram_odds = _odds(gram_counts[1], gram_counts[0], share)
    net = Network(vocab, rng)
    model = Model(net)
    place = np.array([vocab.get(w, 0) for w in words], dtype=np.int64)
    # First windows are chosen by log-odds, later ones by the network itself.
    hint = np.maximum.reduceat(np.concatenate([gram_odds[grams], [0]]), np.minimum(first[:-1], len(grams)))
    hint = np.where(np.diff(first) > 0, hint, 0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    turn = 0
    for r in range(rounds):
        chosen = []
        if r:
            # Window scores of the sampled texts under the network so far.
            model.base = None
            logits = np.concatenate([model.score_windows(texts[a : a + 512])[0] for a in range(0, len(texts), 512)])
        at = 0
        for i, d in enumerate(ids):
            starts = windows_of(len(d))
            value = logits[at : at + len(starts)] if r else [hint[d[s : s + WINDOW]].max() for s in starts]
            at += len(starts)
            best = int(np.argmax(value))
            chosen.append((i, starts[best]))
            if not labels[i]:
                chosen.append((i, starts[int(rng.integers(len(starts)))]))
        steps = -(-len(chosen) // BATCH)
        for _ in range(max(PASSES, -(-MIN_STEPS // steps))):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), BATCH):
                batch = [chosen[k] for k in order[a : a + BATCH]]
                raw = np.zeros((len(batch), WINDOW), np.int64)
                mask = np.zeros((len(batch), WINDOW), np.float32)
                for j, (i, s) in enumerate(batch):
                    w = ids[i][s : s + WINDOW]
                    raw[j, : len(w)], mask[j, : len(w)] = w, 1
                used, idx = np.unique(raw, return_inverse=True)
                spans = np.diff(first)[used]
                part = np.repeat(first[used] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                own = np.repeat(np.arange(len(used)), spans)
                # Half of the words are hidden, so that their characters have to do.
                shown = np.where(rng.random(len(used)) < 0.5, place[used], 0)
                x, count = net.inputs(shown, grams[part], own, len(used))
                label = np.array([labels[i] for i, _ in batch], np.float32)
                g, dx = net.step(x, idx.reshape(raw.shape), mask, label)
                g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
                np.add.at(g["word"], shown, dx[:, :WORD_DIM])
                g["word"][0] = 0
                np.add.at(g["gram"], grams[part], (dx[:, WORD_DIM:] / np.maximum(count, 1)[:, None])[own])
                turn += 1
                for k, v in net.p.items():
                    m1, m2 = moments[k]
                    m1 += 0.1 * (g[k] - m1)
                    m2 += 0.001 * (g[k] * g[k] - m2)
                    v -= RATE / (1 + r) * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.999**turn)) + 1e-7)
    model.base = None
    return model


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """Train on a bounded sample of the documents that ``labels`` marks 0 or 1."""
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    sample = bounded_sample(marked.distinct(), ["id"], sample_rows, 0, SEED, by="label")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    held = pinned(texts.join(lookup(sample), "id"))
    rows = bounded_sample(held, ["id", "text"], sample_rows, sample_bytes, SEED, text="text", by="label").orderBy("id", "label", "text").select("text", "label").toArrow()
    return train(rows["text"].to_pylist(), rows["label"].to_numpy().astype(np.int64))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1).to_pylist()))], ["id", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(score, f"id {id_type}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(sent.value.score(texts) < threshold))

    return docs.mapInArrow(clean, docs.schema)
