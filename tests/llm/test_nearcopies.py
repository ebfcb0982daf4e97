"""Near copies against all pairs by brute force."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import nearcopies, simhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_kept(rows):
    """rows: (id, text); one (id, set) of every group."""
    nodes = sorted({(i, tuple(sorted(brute_set(t)))) for i, t in rows})
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (j, (_, s)), (k, (_, t)) in combinations(enumerate(nodes), 2):
        s, t = set(s), set(t)
        if s == t or 5 * len(s & t) >= 4 * len(s | t):
            a, b = sorted((find(j), find(k)))
            root[b] = a
    return sorted((nodes[k][0], frozenset(nodes[k][1])) for k in range(len(nodes)) if find(k) == k)


def _texts():
    """Originals of 60 to 200 words with copies from 0.5 to 1 of their similarity."""
    rng, out = np.random.default_rng(8), [None, "", "  ", "one", "ONE", "one two three four"]
    for _ in range(25):
        words = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(60, 200)))]
        out.append(" ".join(words))
        for swaps in (0, 1, 1, 2, 3, 4, 6):
            copy = list(words)
            for at in rng.integers(0, len(copy), swaps):
                copy[at] = f"x{at}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("pair_rows", [16, 1])
def test_stage_keeps_what_brute_force_keeps(spark, pair_rows):
    rows = list(enumerate(_texts()))
    docs = spark.createDataFrame([(i, t, "more") for i, t in rows], "doc_id long, text string, cell string").repartition(3)
    kept = nearcopies.keep_representatives(docs, pair_rows=pair_rows)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in brute_kept(rows)]


def test_near_copies_share_a_key():
    """Pairs from the threshold on: words replaced anywhere, or a block put in."""
    rng, texts = np.random.default_rng(4), []
    for k in range(400):
        words = [f"w{n}" for n in rng.integers(0, 9000, int(rng.integers(80, 400)))]
        copy = list(words)
        if k % 4:
            for at in rng.integers(0, len(copy), len(copy) // 50):
                copy[at] = f"x{at}"
        else:
            copy[len(copy) // 2 : len(copy) // 2] = [f"y{n}" for n in range(len(copy) // 10)]
        texts += [" ".join(words).encode(), " ".join(copy).encode()]
    held = nearcopies._split(nearcopies.shingle_sets(texts, 5))
    fps = nearcopies.set_fingerprints(nearcopies.shingle_sets(texts, nearcopies.FEATURE))
    place, key, mark = nearcopies.key_marks(fps, np.array([len(s) for s in held]))
    order = np.lexsort((place, key))
    place, key, mark = place[order], key[order], mark[order]
    left, right, root = nearcopies.cluster_pairs(key, mark, simhash.Golay(), 16)
    assert (key[left] == key[right]).all() and (root == -1).all(), "no large cluster here"
    found = set(zip(np.minimum(place[left], place[right]).tolist(), np.maximum(place[left], place[right]).tolist()))
    due = met = 0
    for a in range(0, len(texts), 2):
        s, t = held[a], held[a + 1]
        if nearcopies.similar(len(np.intersect1d(s, t)), len(s), len(t)):
            due += 1
            met += (a, a + 1) in found
    assert due > 200 and met >= 0.97 * due


def test_clusters_hold_every_candidate_pair():
    """Pairs of small clusters and members of large ones against all pairs of rows."""
    rng, golay = np.random.default_rng(5), simhash.Golay()
    middle = rng.integers(0, 1 << 55, 12)
    flip = lambda n: sum(1 << int(b) for b in rng.choice(np.arange(7, 55), n, replace=False))
    mark = np.array([int(middle[k % 12 if k % 3 else 0]) ^ flip(int(rng.integers(0, 8))) for k in range(400)])
    key = np.sort(rng.integers(0, 4, 400))
    place, index = golay.indices(mark >> 32)
    own = [set(index[place == k].tolist()) for k in range(400)]
    want = {(i, j) for i, j in combinations(range(400), 2) if key[i] == key[j] and own[i] & own[j] and nearcopies.candidates(mark[i], mark[j])}
    left, right, root = nearcopies.cluster_pairs(key, mark, golay, 4)
    found = set(zip(np.minimum(left, right).tolist(), np.maximum(left, right).tolist()))
    assert found <= want and all((i, j) in found or root[i] == root[j] >= 0 for i, j in want) and found and (root >= 0).any()
    assert len(found) <= 4 * 400 and all(key[root[k]] == key[k] for k in range(400) if root[k] >= 0)


def test_shingle_sets_match_brute_force():
    texts = [t.encode() if t else b"" for t in _texts()]
    for size in (2, 5):
        sets = nearcopies._split(nearcopies.shingle_sets(texts, size))
        words = [t.lower().split() for t in texts]
        want = [{tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set() for w in words]
        assert [len(s) for s in sets] == [len(w) for w in want] and all((np.diff(s.astype(object)) > 0).all() for s in sets)
        for a, b in [(6, 7), (8, 9), (10, 14), (3, 4)]:
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


def test_forest_spans_a_bucket():
    sets = [np.sort(np.array(s, dtype=np.uint64)) for s in (range(10), range(1, 11), range(2, 12), range(50, 60), range(50, 59))]
    assert sorted(nearcopies.forest(sets, np.arange(5))) == [(0, 1), (1, 2), (3, 4)]


def test_empty_table(spark):
    assert nearcopies.keep_representatives(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_stage_keeps_texts_that_only_fingerprints_link(spark):
    """Repeated lines make up all fingerprints; of the shingles, few are shared."""
    lines = "same line again " * 150
    rows = [(k, lines + " ".join(f"{k}u{n}" for n in range(20))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = simhash.fingerprints([t.encode() for _, t in rows])
    assert (np.bitwise_count(fps[:1] ^ fps) <= 3).all() and len(brute_kept(rows)) == 4
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [0, 1, 2, 3]


def test_columns_of_any_name_are_carried_along(spark):
    names = ["_keep", "_kept", "_times", "_again", "_n", "_node", "node", "root", "size", "fps", "id", "key", "a", "b", "_id"]
    rows = [(3, "A b c d e f", *names), (1, "a b c d e f", *names), (3, "g h i j k l", *names), (None, "m", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["text"][0] != "A")


def test_rows_that_repeat_an_id_stay_with_their_own_texts(spark):
    rows = [(1, "a b c d e f"), (3, "A b c d e f"), (3, "g h i j k l"), (3, "g h i j k l"), (3, "m n o p q r"), (7, "G h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c d e f"), (3, "g h i j k l"), (3, "m n o p q r")]
