import copy
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import lm
from vellum.llm.queries import op3_lm


def rows():
    rng = random.Random(5)
    one, two = ([f"{c}{k}" for k in range(60)] for c in "pq")
    out = [(i, " ".join(rng.choice(one if i % 2 else two) for _ in range(rng.randrange(5, 60)))) for i in range(300)]
    return out + [(900, None), (901, ""), (902, "P1 p1\x0bq2 rareword"), (902, "P1 p1\x0bq2 rareword"), (None, "q1"), (903, "p3 " * 4000)]


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lm")
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows()], "doc_id long, text string, row int, token string").write.parquet(f"{path}/documents.parquet")
    return op3_lm(spark, str(path)).collect()


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_base_matches_the_formula(scored):
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7
    count = Counter(w for i, t in rows() if fold(i) != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(i), fold(i) == 2, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows()
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored) == want


def test_held_out_documents_beat_the_base(scored):
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in scored)


def small_model():
    hot = {b"": 9, b"a": 7, b"b": 5, b"c": 2, b"d": 1}
    rest = np.zeros(lm.RESTS)
    for w, n in hot.items():
        if w:
            rest[lm.rest_class(w)] += n + 1
    model = lm.Model(sum(hot.values()), len(hot), hot, rest)
    model.fit([b"a b a b", b"c a", b"", b"b a d"] * 5, passes=2)
    return model


def test_next_word_probabilities_sum_to_one():
    """Over the vocabulary and the rest classes, after any history."""
    model = small_model()
    net, size = model.network, len(model.symbol)
    every = np.arange(size + lm.RESTS)
    states = np.repeat(np.random.default_rng(0).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), len(every), 0)
    assert abs(np.exp(net.log_probs(states, every).astype(float)).sum() - 1) < 1e-4


def test_window_scoring_matches_one_by_one():
    model = small_model()
    net = model.network
    docs = [model.symbols(lm.lower_words(t)) for t in (b"a b c unseen a", b"", b"b " * 300, b"d d")]
    flat = np.array([s for d in docs for s in d])
    size = np.array([len(d) for d in docs])
    got = net.score(flat, np.cumsum(size) - size, size, model.end)
    for d, total in zip(docs, got):
        state, before, want = np.zeros(lm.HIDDEN), model.end, 0.0
        for s in d:
            x = net.p["in"][before] @ net.p["wx"] + net.p["bx"]
            q = state @ net.p["wh"]
            h = lm.HIDDEN
            gates = 1 / (1 + np.exp(-(x[: 2 * h] + q[: 2 * h])))
            n = np.tanh(x[2 * h :] + gates[:h] * q[2 * h :])
            state = (1 - gates[h:]) * n + gates[h:] * state
            want += net.log_probs(state[None].astype(np.float32), np.array([s]))[0]
            before = s
        assert abs(want - total) < 1e-3 * max(1, abs(want))


def test_score_matches_brute_force(spark):
    """Token by token, with words beyond the frequent ones and words that no training text has."""
    docs = spark.createDataFrame([(i, t) for i, t in rows()], "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id < 200")
    model, counts = lm.learn(train, hot_words=20)
    assert len(model.symbol) < 25
    seen = Counter(w for i, t in rows() if i is not None and i < 200 for w in tokens(t))
    net, size, h = model.network, len(model.symbol), lm.HIDDEN
    for k in range(lm.RESTS):
        own = sum(n + 1 for w, n in seen.items() if w and w not in model.symbol and lm.rest_class(w) == k)
        assert model.rest_share[k] == own + 1, "the shares of a class and one for unseen words"
    want = []
    for i, text in rows():
        state, before, total = np.zeros(h), model.end, 0.0
        for w in tokens(text):
            s = model.symbol.get(w, size + lm.rest_class(w))
            x = net.p["in"][before] @ net.p["wx"] + net.p["bx"]
            q = state @ net.p["wh"]
            gates = 1 / (1 + np.exp(-(x[: 2 * h] + q[: 2 * h])))
            state = (1 - gates[h:]) * np.tanh(x[2 * h :] + gates[:h] * q[2 * h :]) + gates[h:] * state
            total += net.log_probs(state[None].astype(np.float32), np.array([s]))[0] / math.log(10)
            if s >= size:
                total += math.log10((seen[w] + 1) / model.rest_share[s - size])
            before = s
        base = sum(math.log10((seen[w] + 1) / (sum(seen.values()) + len(seen) + 1)) for w in tokens(text))
        want.append((str(i), len(tokens(text)), sum(seen[w] > 0 for w in tokens(text)), base, total))
    got = sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm.score_documents(docs, model, counts).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert np.allclose(g[3:], w[3:], rtol=1e-3, atol=1e-3)


def test_rounds_average_the_copies_of_all_partitions(spark):
    model = small_model()
    texts = [("a b " * 40,), ("c a d " * 30,), (None,), ("b " * 200,)]
    docs = spark.createDataFrame(texts, "text string").repartition(3)
    start = lm._flat(model.network)
    copies, weight = [], []
    for part in docs.rdd.glom().collect():
        held = [model.symbols(lm.lower_words((r["text"] or "").encode())) for r in part]
        if held:
            net = copy.deepcopy(model.network)
            trainer = lm.Trainer(net)
            trainer.run(held, model.end, lm.ROUND_STREAMS, lambda _: lm.ROUND_RATE)
            copies.append(lm._flat(net))
            weight.append(trainer.tokens)
    assert lm.train_round(docs, model) and len(copies) > 1 and sum(weight) == sum(len(tokens(t)) for (t,) in texts)
    got = lm._flat(model.network)
    assert np.allclose(got, np.average(copies, axis=0, weights=weight), atol=1e-5) and not np.allclose(got, start, atol=1e-5)
    assert not lm.train_round(docs.limit(0), model) and (lm._flat(model.network) == got).all()


def test_gradients():
    net = small_model().network
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(1)
    source, target = rng.integers(0, 5, (6, 3)), rng.integers(0, 8, (6, 3))
    fresh, live, state = rng.random((6, 3)) < 0.3, np.ones((6, 3)), rng.normal(0, 1, (lm.HIDDEN, 3))
    loss = lambda: net.step(source, target, fresh, live, state)[0]
    _, g, _ = net.step(source, target, fresh, live, state)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), p.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 0.03 * abs(g[k][at]) + 1e-4, k


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model, counts = lm.learn(docs.limit(0))
    assert lm.score_documents(docs.limit(0), model, counts).collect() == []
    r = lm.score_documents(docs, model, counts).first()
    assert r["base_score"] == 0.0 and r["n_known"] == 0 and r["n_tokens"] == 3 and r["score"] < 0


def test_rare_words_are_counted_by_text():
    """Each rare occurrence comes with its text, and its rest class is that of the word, also for words of one or two bytes."""
    texts = [b"a rare rare x", b"", b"rare \xc3\xa9\xc3\xa9 a"]
    model = lm.Model(10, 3, {b"a": 5, b"": 3}, np.full(lm.RESTS, 50.0))
    model.fit([])
    count, known, _, _, rare, at = model.score(texts)
    assert count.tolist() == [5, 1, 4] and known.tolist() == [2, 1, 2]
    assert list(zip(rare.to_pylist(), at.tolist())) == [(b"rare", 0), (b"rare", 0), (b"x", 0), (b"rare", 2), (b"\xc3\xa9\xc3\xa9", 2)]
    assert lm.rest_classes(rare.dictionary).tolist() == [lm.rest_class(w) for w in rare.dictionary.to_pylist()]


def test_counts_that_are_sent_early(spark):
    texts = [f"a w{i} w{i % 3} É" for i in range(50)] + [None, " "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    want = Counter([b""] * 52 + [w for t in texts for w in lm.lower_words((t or "").encode())])
    for held in (1, 20, 10_000):
        assert {r["token"].encode(): r["n"] for r in lm.count_tokens(docs, held=held).collect()} == want
    assert lm.count_tokens(docs.limit(0)).count() == 0
