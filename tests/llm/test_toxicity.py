import random
import re
import zlib

import numpy as np

from vellum.llm import toxicity
from vellum.llm.common import text_fold
from vellum.llm.queries import op9_toxicity


def rows(n=300):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st"]) for _ in range(rng.randrange(1, 5)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(3, 150))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "vilk" + word())
        out.append((i, " ".join(words), int(toxic)))
    return out


def write(spark, path, data):
    more = [(9001, None, None), (9002, "", None), (9003, "an er", None), (9003, "an er", None), (None, "vilkan", None)]
    spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in data + more], "doc_id long, text string, score double, id string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in data] + [(1, 0, None), (7777, 1, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy(spark, tmp_path):
    data = rows()
    write(spark, tmp_path, data)
    got = op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(data) + 5
    truth = {i: y for i, _, y in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_windows_cover_the_text():
    for n in range(1, 200):
        starts = toxicity.windows_of(n)
        seen = {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_scores_do_not_depend_on_neighbours():
    data = rows(60)
    model = toxicity.train([t for _, t, _ in data], np.array([y for _, _, y in data]), rounds=1)
    texts = [t for _, t, _ in data] + [None, "one", "w " * 3000]
    assert np.allclose(model.score(texts), np.concatenate([model.score([t]) for t in texts]), atol=1e-4)
    assert model.score([]).shape == (0,)


def brute_score(model, text):
    """One word and one window after the other, in the definition's own terms."""
    net, h = model.network, toxicity.HIDDEN
    p = {k: v.astype(float) for k, v in net.p.items()}
    words = [w for w in re.split(rb"[^a-z0-9\x80-\xff]+", (text or "").lower().encode()) if w] or [b""]

    def vector(word):
        data, grams = b"<" + word + b">", []
        for n in (3, 4, 5):
            for i in range(len(data) - n + 1):
                x = n
                for c in data[i : i + n]:
                    x = (x ^ c) * 0x100000001B3 % 2**64
                    x ^= x >> 23
                grams.append((x * 0x9E3779B97F4A7C15 % 2**64 >> 48) % toxicity.BUCKETS)
        chars = p["gram"][grams].mean(0) if grams else np.zeros(toxicity.CHAR_DIM)
        return np.concatenate([p["word"][net.vocab.get(word, 0)], chars])

    def read(rows, d):
        state, out = np.zeros(h), []
        for x in rows if d == 0 else rows[::-1]:
            a, q = x @ p[f"w{d}"] + p[f"b{d}"], state @ p[f"r{d}"]
            r, z = 1 / (1 + np.exp(-(a[:h] + q[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + q[h : 2 * h])))
            n = np.tanh(a[2 * h :] + r * q[2 * h :])
            state = (1 - z) * n + z * state
            out.append(state)
        return out if d == 0 else out[::-1]

    best = -np.inf
    for s in range(0, max(len(words) - toxicity.WINDOW, 0) + 1):
        if s % toxicity.STRIDE and s != len(words) - toxicity.WINDOW:
            continue
        rows = [vector(w) for w in words[s : s + toxicity.WINDOW]]
        states = np.concatenate([read(rows, 0), read(rows, 1)], axis=1)
        weight = np.exp(states @ p["v"])
        best = max(best, (weight * (states @ p["u"])).sum() / weight.sum() + p["c"][0])
    return 1 / (1 + np.exp(-best))


def test_query_matches_brute_force(spark, tmp_path):
    """All rows of the query, by the network that it has learned."""
    data = rows(60)
    write(spark, tmp_path, data)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(docs, labels.filter(text_fold("doc_id", 5) != 0))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((i, zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0, brute_score(model, t)) for i, t in texts), key=str)
    got = sorted(((r["doc_id"], r["held_out"], r["score"]) for r in op9_toxicity(spark, str(tmp_path)).collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)


def test_sample_holds_one_row_per_label_and_stays_bounded(spark, tmp_path):
    """Labels that repeat, have no document or no id teach nothing twice; extra columns of the documents stay out."""
    write(spark, tmp_path, rows(40))
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    once, twice = (toxicity.learn(docs, x, sample_rows=10) for x in (labels, labels.union(labels)))
    assert all((once.network.p[k] == twice.network.p[k]).all() for k in once.network.p)


def test_stage_carries_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "x", 0.5, "a"), (None, None, 1.0, "b")], "doc_id long, text string, score double, label string")
    kept = toxicity.drop_toxic(docs, toxicity.Model(None, 0.0))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_one_class_is_a_constant():
    assert toxicity.train(["a"], np.array([1])).score(["x", None]).tolist() == [1.0, 1.0]
    assert toxicity.train([], np.zeros(0, int)).score(["x"]).tolist() == [0.0]


def test_gradients():
    rng = np.random.default_rng(2)
    net = toxicity.Network({b"a": 1, b"b": 2}, rng)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.normal(0, 1, (5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    idx, mask = rng.integers(0, 5, (3, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], float)
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(x.astype(np.float32), idx.T, mask.T > 0).astype(float)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    g, dx = net.step(x, idx, mask, label)
    for p, d in [(net.p[k], g[k]) for k in g] + [(x, dx)]:
        at = np.unravel_index(np.abs(d).argmax(), p.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - d[at]) < 0.05 * abs(d[at]) + 1e-3
