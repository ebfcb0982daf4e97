"""Document log-likelihood under a gated recurrent language model.

The vocabulary is the ``VOCAB`` most frequent training words and the end mark, in
classes of ``CLASS_SIZE`` of similar frequency; all other words fall into ``RESTS`` rest
classes by their first bytes. The softmax is factored: P(class | state) times P(word |
class, state), or, in a rest class, the word's add-one share of the class by the counts
of the whole training corpus, with one share for unseen words. So a document's score is
a proper probability over the same events as the add-one unigram base.

Training is truncated backpropagation in numpy over all training documents. The driver
warms a network up on a bounded sample; then, ``ROUNDS`` times, every partition trains a
copy on its documents of that round and the copies' parameters are averaged, weighted by
tokens, so the work grows with the corpus and the driver sees one network a round. Token
counts cover the whole training corpus. In scoring, the state is carried from window to
window through the complete document.

Word counts are too many for one machine: frequent words, of bounded number, travel to
the workers with the model, all others are looked up by a shuffled join.

Defined cases: a null text counts as empty and is its end mark alone; without training
documents every count is zero; rows without an id are dealt to rounds by their texts;
repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, coded_words, least_count, listed, lower_words, shared_path, slices

VOCAB = 4095
CLASS_SIZE = 64
RESTS = 64
HEAD = 3
HOT_WORDS = 524_288
#: Documents, and their bytes, that the driver warms the network up on.
WARM_ROWS, WARM_BYTES = 1_000, 4_000_000
HIDDEN, EMBED = 16, 16
STREAMS, STEPS, PASSES, RATE = 48, 32, 1, 0.01
#: Passes over the partitions, each with its own part of the documents, and their learning rate.
ROUNDS, ROUND_RATE = 2, 0.003
#: Streams, and documents that are dealt to them at a time, of a partition.
ROUND_STREAMS, ROUND_DOCS = 256, 1024
#: Parameters that travel in one row.
CHUNK = 4096
SEED = 37
#: The end mark as a counted token; no word is empty.
END = b""
LOG10 = np.log(10.0)


def rest_class(word: bytes) -> int:
    return zlib.crc32(word[:HEAD]) % RESTS


def rest_classes(words: pa.Array) -> np.ndarray:
    """rest_class of each word; words with one beginning are of one class."""
    heads = pc.binary_slice(words, 0, HEAD).dictionary_encode()
    return np.array([rest_class(h) for h in heads.dictionary.to_pylist()], dtype=np.int64)[heads.indices.to_numpy()]


def _with_bias(weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights with the bias as their last row, and whether logits may be large; for one matrix or a stack of them.

    States lie within one, so a bound on the logits follows from the weights.
    """
    large = (np.abs(weight).sum(-2) + bias).max(-1) > 60
    return np.concatenate([weight, bias[..., None, :]], axis=-2), large


def _exponents(states: np.ndarray, weight: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits less a shift common to a row, their sums, and the logs of the sums without the shift.

    ``states`` end with a one for the bias. Only where logits may be large are they shifted, by the rows' own maxima.
    """
    x = states @ weight
    shift = x.max(1) if large else np.zeros(1, x.dtype)
    if large:
        x -= shift[:, None]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return x, total, np.log(total) + shift


def _with_one(states: np.ndarray) -> np.ndarray:
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)


class Network:
    """One gated recurrent layer with class-factored outputs.

    Symbols are places in the vocabulary, then rest classes. Class k has the words of
    places k * CLASS_SIZE onward; rest classes follow the word classes.
    """

    def __init__(self, counts: np.ndarray, rest_counts: np.ndarray, rng: np.random.Generator) -> None:
        """``counts`` of the vocabulary in descending order; ``rest_counts`` of rest classes."""
        self.size = len(counts)
        self.classes = -(-self.size // CLASS_SIZE)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        h, e = HIDDEN, EMBED
        padded = np.zeros(self.classes * CLASS_SIZE)
        padded[: self.size] = counts + 1
        by_class = padded.reshape(self.classes, CLASS_SIZE)
        # Words beyond the vocabulary in the last class must not take any probability.
        bias = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -1e9)
        self.p = {
            "in": small(self.size + RESTS, e) * 5,
            "wx": small(e, 3 * h) * 2,
            "bx": np.zeros(3 * h, np.float32),
            "wh": small(h, 3 * h) * 2,
            "oc": small(h, self.classes + RESTS),
            "bc": np.log(np.concatenate([by_class.sum(1), rest_counts])).astype(np.float32),
            "ow": small(self.classes, h, CLASS_SIZE),
            "bw": bias.astype(np.float32),
        }
        self.p["bc"] -= np.log(np.exp(self.p["bc"] - self.p["bc"].max()).sum()) + self.p["bc"].max()

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.size, symbol // CLASS_SIZE, self.classes + symbol - self.size)

    def step(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, live: np.ndarray, state: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss, gradients and last state over (steps, streams); ``fresh`` resets a stream's state.

        States are columns: (hidden, streams).
        """
        p, h = self.p, HIDDEN
        t, b = inputs.shape
        kind = p["wh"].dtype
        x = p["in"][inputs.ravel()]
        proj = np.ascontiguousarray((x @ p["wx"] + p["bx"]).reshape(t, b, 3 * h).transpose(0, 2, 1))
        turn, keep = np.ascontiguousarray(p["wh"].T), (~fresh).astype(kind)
        before, states = np.empty((t, h, b), kind), np.empty((t, h, b), kind)
        q3, gates, new = np.empty((t, h, b), kind), np.empty((t, 2 * h, b), kind), np.empty((t, h, b), kind)
        for k in range(t):
            np.multiply(state, keep[k], out=before[k])
            q = turn @ before[k]
            g = np.add(proj[k, : 2 * h], q[: 2 * h], out=gates[k])
            np.negative(g, out=g)
            np.minimum(g, 30, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            q3[k] = q[2 * h :]
            n = np.multiply(g[:h], q3[k], out=new[k])
            n += proj[k, 2 * h :]
            np.tanh(n, out=n)
            state = np.subtract(before[k], n, out=states[k])
            state *= g[h:]
            state += n
        r, z = gates[:, :h], gates[:, h:]
        flat, want = _with_one(states.transpose(0, 2, 1).reshape(-1, h)), targets.ravel()
        weight = (live.ravel() / max(live.sum(), 1)).astype(kind)
        cls = self.class_of(want)
        # The gradient of logits is the softmax less one at the target. The two are taken apart:
        # the softmax is neither scaled nor changed in place, and what targets pull at is summed
        # by symbol over rows that are sorted by it, so that classes are slices.
        by = np.argsort(want.astype(np.int16), kind="stable")
        flat, want, cls, weight = flat[by], want[by], cls[by], weight[by]
        pulled = flat * weight[:, None]
        out, large = _with_bias(p["oc"], p["bc"])
        e, total, log_total = _exponents(flat, out, large)
        loss = ((log_total - (flat * out.T[cls]).sum(1)) * weight).sum()
        share = (weight / total)[:, None]
        g_out = (flat * share).T @ e
        d_flat = share * (e @ p["oc"].T) - weight[:, None] * p["oc"].T[cls]
        cuts = np.searchsorted(cls, np.arange(self.classes + RESTS + 1))
        full = np.flatnonzero(np.diff(cuts))
        g_out[:, full] -= np.add.reduceat(pulled, cuts[full], axis=0).T
        stack, wide = _with_bias(p["ow"], p["bw"])
        g_stack, words = np.zeros_like(stack), full[full < self.classes]
        for c in words:
            rows = slice(cuts[c], cuts[c + 1])
            part = flat[rows]
            e, total, log_total = _exponents(part, stack[c], wide[c])
            loss += (log_total * weight[rows]).sum()
            share = (weight[rows] / total)[:, None]
            np.matmul((part * share).T, e, out=g_stack[c])
            d_flat[rows] += share * (e @ p["ow"][c].T)
        known = int(cuts[self.classes])
        if known:
            flat, want, weight, pulled = flat[:known], want[:known], weight[:known], pulled[:known]
            turned = np.ascontiguousarray(stack.transpose(0, 2, 1)).reshape(-1, h + 1)
            asked = turned[want]
            loss -= ((flat * asked).sum(1) * weight).sum()
            d_flat[:known] -= weight[:, None] * asked[:, :h]
            first = np.flatnonzero(np.concatenate([[True], want[1:] != want[:-1]]))
            turned = np.zeros_like(turned)
            turned[want[first]] = np.add.reduceat(pulled, first, axis=0)
            g_stack -= turned.reshape(-1, CLASS_SIZE, h + 1).transpose(0, 2, 1)
        grad = {"oc": g_out[:h], "bc": g_out[h], "ow": np.ascontiguousarray(g_stack[:, :h]), "bw": np.ascontiguousarray(g_stack[:, h])}
        back = np.empty_like(d_flat)
        back[by] = d_flat
        d_flat = back
        d_states = np.ascontiguousarray(d_flat.reshape(t, b, h).transpose(0, 2, 1))
        to_new, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), q3 * r * (1 - r)
        dq, d_new, d_state = np.empty((t, 3 * h, b), kind), np.empty((t, h, b), kind), np.zeros((h, b), kind)
        for k in range(t - 1, -1, -1):
            d_state += d_states[k]
            dn = np.multiply(d_state, to_new[k], out=d_new[k])
            np.multiply(dn, to_r[k], out=dq[k, :h])
            np.multiply(d_state, to_z[k], out=dq[k, h : 2 * h])
            np.multiply(dn, r[k], out=dq[k, 2 * h :])
            d_state *= z[k]
            d_state += p["wh"] @ dq[k]
            d_state *= keep[k]
        rows = lambda a: np.ascontiguousarray(a.transpose(0, 2, 1)).reshape(t * b, -1)
        dp = rows(dq)
        grad["wh"] = rows(before).T @ dp
        dp[:, 2 * h :] = rows(d_new)
        grad["wx"], grad["bx"] = x.T @ dp, dp.sum(0)
        # Gradients of equal inputs are summed by sorting, which beats adding them one by one.
        by = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        read = inputs.ravel()[by]
        first = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
        grad["in"] = np.zeros_like(p["in"])
        grad["in"][read[first]] = np.add.reduceat((dp @ p["wx"].T)[by], first, axis=0)
        return float(loss), grad, state

    def log_probs(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log P(class) + log P(word | class), the latter for words only."""
        p, out = self.p, np.empty(len(symbols), np.float32)
        order = np.argsort(symbols.astype(np.int16), kind="stable")
        symbols, states = symbols[order], _with_one(states)[order]
        cls = self.class_of(symbols)
        held, large = _with_bias(p["oc"], p["bc"])
        logs = (states * held.T[cls]).sum(1)
        for a in range(0, len(symbols), 16_384):
            part = slice(a, a + 16_384)
            logs[part] -= _exponents(states[part], held, large)[2]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        known = slice(0, int(cuts[self.classes]))
        stack, wide = _with_bias(p["ow"], p["bw"])
        logs[known] += (states[known] * stack.transpose(0, 2, 1).reshape(-1, HIDDEN + 1)[symbols[known]]).sum(1)
        for c in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[c], cuts[c + 1])
            logs[rows] -= _exponents(states[rows], stack[c], wide[c])[2]
        out[order] = logs
        return out

    def score(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, first: int) -> np.ndarray:
        """Sum of log_probs of each document's symbols; every document has at least one.

        Documents advance side by side, longest first, one window of steps after the
        other; states go on from window to window. ``first`` is the input of first steps.
        """
        p, h = self.p, HIDDEN
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        proj = np.ascontiguousarray((p["in"] @ p["wx"] + p["bx"]).T)
        turn = np.ascontiguousarray(p["wh"].T)
        total = np.zeros(len(size))
        state = np.zeros((h, len(size)), np.float32)
        previous = np.full(len(size), first, dtype=np.int64)
        at, longest = 0, int(size[0]) if len(size) else 0
        while at < longest:
            width = int(np.searchsorted(-size, -at, "left"))
            window = min(longest - at, max(32, 65_536 // width))
            kept, asked, of = [], [], []
            for k in range(at, at + window):
                live = int(np.searchsorted(-size, -k, "left"))
                if live < state.shape[1]:
                    state = np.ascontiguousarray(state[:, :live])
                g = np.take(proj, previous[:live], axis=1)
                q = turn @ state
                gates = g[: 2 * h]
                gates += q[: 2 * h]
                np.negative(gates, out=gates)
                np.minimum(gates, 30, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                n = g[2 * h :]
                n += gates[:h] * q[2 * h :]
                np.tanh(n, out=n)
                state = (state - n) * gates[h:] + n
                previous = flat[start[:live] + k]
                kept.append(state.T)
                asked.append(previous)
                of.append(live)
            logs = self.log_probs(np.concatenate(kept), np.concatenate(asked)).astype(np.float64)
            text = np.concatenate([np.arange(n) for n in of])
            total[:width] += np.bincount(text, weights=logs, minlength=width)
            at += window
        out = np.empty(len(size))
        out[order] = total
        return out


def with_ends(words: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
    """One value a word, and ``end`` behind the words of each text, of which there are ``size``."""
    out = np.full(len(words) + len(size), end, words.dtype)
    there = np.ones(len(out), bool)
    there[np.cumsum(size + 1) - 1] = False
    out[there] = words
    return out


class Symbols(dict):
    """Symbols of words; those of rest words are remembered, up to a bound."""

    def __init__(self, known: dict[bytes, int], held: int = 500_000) -> None:
        super().__init__(known)
        self.size, self.most = len(known), len(known) + held

    def __missing__(self, word: bytes) -> int:
        symbol = self.size + rest_class(word)
        if len(self) < self.most:
            self[word] = symbol
        return symbol


class Trainer:
    """Truncated backpropagation with adaptive steps, whose moments go on from run to run.

    A line may begin inside a document; its state is empty there and is carried on from then.
    """

    def __init__(self, network: Network) -> None:
        self.net, self.turn, self.tokens = network, 0, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}

    def run(self, docs: list[list[int] | np.ndarray], end: int, streams: int, rate) -> None:
        """One pass over documents (symbols, each one's last is the end mark), one or more at a place, laid out as lines of equal length; ``rate`` of the share done."""
        flat = np.concatenate([np.asarray(d, np.int64) for d in docs])
        streams = max(1, min(streams, len(flat) // STEPS))
        length = -(-len(flat) // streams)
        lines = lambda x: np.pad(x, (0, length * streams - len(flat)), constant_values=end).reshape(streams, length).T
        target, source = lines(flat), lines(np.concatenate([[end], flat[:-1]]))
        live = np.arange(length * streams).reshape(streams, length).T < len(flat)
        fresh, live = source == end, live.astype(np.float32)
        state = np.zeros((HIDDEN, streams), np.float32)
        for a in range(0, length, STEPS):
            part = slice(a, a + STEPS)
            _, g, state = self.net.step(source[part], target[part], fresh[part], live[part], state)
            self.turn += 1
            step = rate(a / length)
            fix1, fix2 = step / (1 - 0.9**self.turn), 1 / (1 - 0.999**self.turn)
            for k, v in self.net.p.items():
                m1, m2 = self.moments[k]
                d = g[k]
                m1 += 0.1 * (d - m1)
                d *= d
                d -= m2
                d *= 0.001
                m2 += d
                np.multiply(m2, fix2, out=d)
                np.sqrt(d, out=d)
                d += 1e-7
                np.divide(m1, d, out=d)
                d *= fix1
                v -= d
        self.tokens += len(flat)


class Model:
    """Network, corpus totals and the frequent words with their counts."""

    def __init__(self, tokens: int, types: int, hot: dict[bytes, int], rest_total: np.ndarray) -> None:
        """``rest_total`` sums count + 1 by rest class over all training tokens but the end mark."""
        self.tokens, self.types = tokens, types
        ranked = sorted(hot.items(), key=lambda x: (-x[1], x[0]))
        vocab = [(END, hot.get(END, 0))] + [(w, n) for w, n in ranked if w != END][:VOCAB]
        vocab.sort(key=lambda x: (-x[1], x[0]))
        self.symbol = {w: i for i, (w, _) in enumerate(vocab)}
        self.vocab_counts = np.array([n for _, n in vocab], dtype=np.float64)
        held = np.zeros(RESTS)
        for w, n in vocab:
            if w != END:
                held[rest_class(w)] += n + 1
        #: Shares of each rest class: one for unseen words, count + 1 for every other.
        self.rest_share = rest_total - held + 1
        self.hot = {w: i for i, (w, _) in enumerate(ranked)}
        size = len(vocab)
        self.hot_symbol = np.array([self.symbol[w] if w in self.symbol else size + rest_class(w) for w, _ in ranked], dtype=np.int64)
        self.hot_log = np.log10(np.array([n for _, n in ranked], dtype=np.float64) + 1)
        self.end = self.symbol[END]
        self.end_count = hot.get(END, 0)
        self.network: Network | None = None

    def symbols(self, words: list[bytes]) -> list[int]:
        known = Symbols(self.symbol, 0)
        return [known[w] for w in words] + [self.end]

    def fit(self, texts: list[bytes], seed: int = SEED, passes: int = PASSES) -> None:
        """A new network, warmed up on whole documents."""
        rng = np.random.default_rng(seed)
        self.network = Network(self.vocab_counts, self.rest_share, rng)
        trainer = Trainer(self.network)
        known = Symbols(self.symbol)
        docs = [[known[w] for w in lower_words(t)] + [self.end] for t in texts]
        for lap in range(passes if docs else 0):
            trainer.run([docs[i] for i in rng.permutation(len(docs))], self.end, STREAMS, lambda done: RATE * (1 - 0.9 * (lap + done) / passes))

    def score(self, texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
        """n_tokens, n_known, base and score of each text but for its rare words; those, and the place of each one's text.

        Each rare word still adds log10(count + 1) to base and score, and 1 to n_known if its count is positive.
        """
        vocab, most = len(self.symbol), len(self.hot)
        coded, size = coded_words(pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts)
        words, at = coded.dictionary, coded.indices.to_numpy()
        # Each distinct word is looked up once.
        found = np.fromiter(map(self.hot.get, listed(words), repeat(-1)), np.int64, len(words))
        scarce, held = found < 0, np.maximum(found, 0)
        symbol = self.hot_symbol[held] if most else np.zeros(len(words), np.int64)
        logs = np.where(scarce, 0.0, self.hot_log[held]) if most else np.zeros(len(words))
        unknown = words.filter(pa.array(scarce))
        symbol[scarce] = vocab + rest_classes(unknown)
        place = with_ends(found[at], size, -2)
        flat = with_ends(symbol[at], size, self.end)
        log = with_ends(logs[at], size, np.log10(self.end_count + 1))
        count = size + 1
        start = np.cumsum(count) - count
        left = scarce[at]
        rare = pa.DictionaryArray.from_arrays(pa.array((np.cumsum(scarce) - 1)[at[left]].astype(np.int32)), unknown)
        known = np.add.reduceat(((place >= 0) | ((place == -2) & (self.end_count > 0))).astype(np.int64), start) if len(texts) else np.zeros(0, np.int64)
        base = (np.add.reduceat(log, start) - count * np.log10(self.tokens + self.types + 1)) if len(texts) else np.zeros(0)
        share = np.where(flat >= vocab, log - np.log10(self.rest_share)[np.maximum(flat - vocab, 0)], 0.0)
        score = (np.add.reduceat(share, start) + self.network.score(flat, start, count, self.end) / LOG10) if len(texts) else np.zeros(0)
        return count, known, base, score, rare, np.repeat(np.arange(len(texts)), size)[left]


def count_tokens(docs: DataFrame, text_col: str = "text", held: int = 500_000) -> DataFrame:
    """(token, n) over all texts, the end mark as an empty token. Workers add up to ``held`` types before they send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        ends = 0

        def added() -> pa.Table:
            both = pa.concat_tables(kept).combine_chunks()
            words = both["token"].combine_chunks().dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), weights=both["n"].to_numpy(), minlength=len(words.dictionary))
            return pa.table({"token": words.dictionary, "n": n.astype(np.int64)})

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(table.set_column(0, "token", table["token"].cast(pa.string())).combine_chunks().to_batches())

        for batch in slices(batches, 8192):
            words, size = coded_words(batch.column(0))
            kept.append(pa.table({"token": words.dictionary, "n": np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)}))
            ends += len(size)
            if sum(t.num_rows for t in kept) > held:
                kept[:] = [added()]
                if kept[0].num_rows > held:
                    yield from out(kept.pop())
        if ends:
            kept.append(pa.table({"token": pa.array([END], pa.large_binary()), "n": pa.array([ends], pa.int64())}))
            yield from out(added())

    return docs.select(docs[text_col].alias("text")).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _flat(network: Network) -> np.ndarray:
    return np.concatenate([v.ravel() for v in network.p.values()])


def _fill(network: Network, values: np.ndarray) -> None:
    at = 0
    for k, v in network.p.items():
        network.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size


_CHUNKS = "chunk int, slot int, weight double, held binary"


def _mean(table: pa.Table) -> pa.Table:
    """One row of the weighted mean of the rows' chunks."""
    weight = table["weight"].to_numpy()
    held = np.stack([np.frombuffer(v, np.float32) for v in table["held"].to_pylist()]).astype(np.float64)
    mean = (held * weight[:, None]).sum(0) / weight.sum()
    return pa.table(
        {
            "chunk": pa.array([table["chunk"][0].as_py()], pa.int32()),
            "slot": pa.array([0], pa.int32()),
            "weight": pa.array([weight.sum()]),
            "held": pa.array([mean.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def train_round(docs: DataFrame, model: Model) -> bool:
    """Train a copy of the network on every partition of ``docs`` (text) and average them into the model's.

    Parameters meet in chunks, first within ``slot``, so that no task holds many of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.symbol, model.end, model.network))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, end, network = sent.value
        known, mine = Symbols(symbol), copy.deepcopy(network)
        trainer, held, rows = Trainer(mine), [], 0

        def run(least: int) -> None:
            nonlocal rows
            if rows >= least:
                trainer.run(held, end, ROUND_STREAMS, lambda _: ROUND_RATE)
                held.clear()
                rows = 0

        for batch in slices(batches, ROUND_DOCS):
            words, size = coded_words(batch.column(0))
            symbols = np.fromiter(map(known.__getitem__, listed(words.dictionary)), np.int64, len(words.dictionary))
            held.append(with_ends(symbols[words.indices.to_numpy()], size, end))
            rows += batch.num_rows
            run(ROUND_DOCS)
        run(1)
        if trainer.tokens:
            values = _flat(mine).astype(np.float32)
            chunks = [values[a : a + CHUNK].tobytes() for a in range(0, len(values), CHUNK)]
            n, slot = len(chunks), TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([slot] * n, pa.int32()), pa.array([float(trainer.tokens)] * n), pa.array(chunks, pa.binary())],
                ["chunk", "slot", "weight", "held"],
            )

    copies = docs.mapInArrow(train, _CHUNKS)
    met = copies.groupBy("chunk", "slot").applyInArrow(_mean, _CHUNKS).groupBy("chunk").applyInArrow(_mean, _CHUNKS).orderBy("chunk").toArrow()
    if met.num_rows:
        _fill(model.network, np.concatenate([np.frombuffer(v, np.float32) for v in met["held"].to_pylist()]))
    return bool(met.num_rows)


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, warm_rows: int = WARM_ROWS, warm_bytes: int = WARM_BYTES, rounds: int = ROUNDS
) -> tuple[Model, DataFrame]:
    """A model of the documents, and the table of all their token counts.

    The frequent words are those above the least count that fewer than ``hot_words``
    tokens reach; a histogram of counts finds it.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    count_tokens(docs, text_col).write.parquet(path)
    counts = spark.read.parquet(path)
    rest = F.pmod(F.crc32(F.substring(F.col("token").cast("binary"), 1, HEAD)), F.lit(RESTS))
    totals = counts.groupBy(rest.alias("rest")).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("types"), F.sum(F.when(F.col("token") != "", F.col("n") + 1).otherwise(0)).alias("share")
    )
    rest_total, tokens, types = np.zeros(RESTS), 0, 0
    for r in totals.collect():
        rest_total[r["rest"]] = r["share"]
        tokens, types = tokens + r["tokens"], types + r["types"]
    least = least_count(counts, "n", hot_words)
    table = counts.filter((F.col("n") >= least) | (F.col("token") == "")).toArrow()
    hot = dict(zip(table["token"].cast(pa.binary()).to_pylist(), table["n"].to_pylist()))
    model = Model(tokens, types, hot, rest_total)
    usable = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sample = bounded_sample(usable, ["id", "text"], warm_rows, warm_bytes, SEED, text="text").orderBy("id", "text").select("text").toArrow()
    model.fit([t.encode() for t in sample["text"].to_pylist()])
    turn = F.pmod(F.xxhash64(F.lit(SEED + 1), "id", "text"), F.lit(rounds))
    for r in range(rounds):
        train_round(usable.filter(turn == r).select("text"), model)
    return model, counts


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row.

    A rare word leaves a worker once for all rows of a slice, with the place in it and the
    number of times of each; the rows' own sums travel with them under keys that no word
    has, so the texts are read once.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            row = batch.column(0).to_numpy()
            count, known, base, value, rare, text = sent.value.score(batch.column(2))
            own = pa.StructArray.from_arrays(
                [batch.column(1), pa.array(count), pa.array(known), pa.array(base), pa.array(value)], ["id", "n_tokens", "n_known", "base", "score"]
            )
            n = len(row)
            single = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)))
            none = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.zeros(n, np.int32)))
            first = pa.array(np.full(n, row[0]))
            yield pa.RecordBatch.from_arrays([pa.array([f" {r}" for r in row], pa.string()), first, single, none, own], ["token", "first", "places", "times", "own"])
            # Pairs of a word and a text, by word: each word's texts follow each other.
            pairs, times = np.unique(rare.indices.to_numpy().astype(np.int64) * n + text, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(rare.dictionary) + 1) * n).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % n, times)]
            words = rare.dictionary.cast(pa.string())
            sums = pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), row[0])), *lists, pa.nulls(len(words), own.type)], ["token", "first", "places", "times", "own"])
            for a in range(0, len(words), 100_000):
                yield sums.slice(a, 100_000)

    shape = f"token string, first bigint, places array<int>, times array<int>, own struct<id {id_type}, n_tokens bigint, n_known bigint, base double, score double>"
    parts = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(score, shape)
    # Rows of a slice follow each other, so a row's number is the first one's plus its place.
    met = parts.join(counts, "token", "left").select("own", "first", "n", F.explode(F.arrays_zip("places", "times")).alias("at"))
    more = F.coalesce(F.sum(F.col("at.times") * F.log10(F.col("n") + 1)), F.lit(0.0))
    sums = met.groupBy((F.col("first") + F.col("at.places")).alias("row")).agg(
        F.max("own.id").alias("id"),
        F.sum("own.n_tokens").alias("n_tokens"),
        (F.sum("own.n_known") + F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("at.times"))), F.lit(0))).alias("n_known"),
        (F.sum("own.base") + more).alias("base_score"),
        (F.sum("own.score") + more).alias("score"),
    )
    return sums.drop("row")
