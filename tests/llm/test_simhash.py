from itertools import combinations

import numpy as np
import xxhash

from vellum.llm import components, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows: (id, fp); the smallest id reachable."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, f), (j, g) in combinations(rows, 2):
        if bin(f ^ g).count("1") <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i, _ in rows}


def test_every_error_pattern_leaves_a_choice():
    """Three errors leave an equal segment whose following 23 bits hold at most two."""
    after = [((0x7FFFFF << 16 * (i + 1) % 64) | (0x7FFFFF >> (64 - 16 * (i + 1) % 64) if 16 * (i + 1) % 64 > 41 else 0)) & (2**64 - 1) for i in range(4)]
    for n in range(4):
        for places in combinations(range(64), n):
            e = sum(1 << p for p in places)
            assert any(not e >> 16 * i & 0xFFFF and bin(e & after[i]).count("1") <= 2 for i in range(4))


def test_golay_words_two_bits_apart_share_an_index():
    golay, rng = simhash.Golay(), np.random.default_rng(5)
    for x in rng.integers(0, 1 << 23, 40):
        near = [x] + [x ^ sum(1 << int(b) for b in c) for n in (1, 2) for c in combinations(range(23), n)]
        place, index = golay.indices(np.array(near))
        mine = set(index[place == 0].tolist())
        assert len(mine) in (1, 6)
        for k in range(1, len(near)):
            assert mine & set(index[place == k].tolist())


def test_keys_meet_for_all_close_fingerprints():
    golay, rng = simhash.Golay(), np.random.default_rng(6)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        place, key = simhash.bucket_keys(np.array([x, y], dtype=np.uint64), golay)
        assert set(key[place == 0].tolist()) & set(key[place == 1].tolist())


def test_fingerprints_match_the_definition():
    texts = [b"", b"one", b"One  two", b"a b c", b"a\x0bb c d e f g A b", b"x y z " * 40, "é É ß ü".encode()]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t.decode()) for t in texts]


def _texts():
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 400, 90)) for _ in range(12)]
    out = []
    for b in base:
        out += [b, b]
        for _ in range(6):
            words = b.split()
            words[int(rng.integers(0, 90))] = "swap"
            out.append(" ".join(words))
    return out + [None, "", "   ", "one", "one two", "ONE two"]


def _check(spark, bucket_rows):
    rows = [(i * 3, t) for i, t in enumerate(_texts())] + [(0, _texts()[0]), (None, "one")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, fp int")
    got = simhash.near_duplicates(docs, bucket_rows=bucket_rows).collect()
    want = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_components(sorted({r for r in want if r[0] is not None}))
    assert sorted(((r["id"], r["fp"] % 2**64, r["component"]) for r in got), key=str) == sorted(((i, f, roots.get(i)) for i, f in want), key=str)


def test_components_match_brute_force(spark):
    _check(spark, 32_768)


def test_oversized_buckets_go_the_exact_way(spark):
    _check(spark, 2)


def test_links_are_at_most_one_a_row_and_bucket(spark):
    """A large group of near copies: links in proportion to fingerprints, not to pairs."""
    rng = np.random.default_rng(14)
    middle = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique([middle ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))) for _ in range(900)])
    marks = spark.createDataFrame([(int(f.astype(np.int64)), k) for k, f in enumerate(fps)], "fp long, node long")
    links = simhash.fingerprint_links(marks).distinct().count()
    assert len(fps) - 1 <= links <= 12 * len(fps)


def test_components_of_chains_stars_and_rings(spark):
    rng = np.random.default_rng(2)
    name = rng.permutation(4000).tolist()
    edges = [(k, k + 1) for k in range(300)] + [(name[1000 + k], name[1001 + k]) for k in range(300) if k != 150]
    edges += [(name[2000], name[2001 + k]) for k in range(200)] + [(5000 + k, 5000 + (k + 1) % 50) for k in range(50)] + [(9000, 9000)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(400):
        for x, y in edges:
            if x != y:
                root[x] = root[y] = min(root[x], root[y])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_majority_matches_counting():
    rng = np.random.default_rng(7)
    counts = np.array([0, 1, 2, 63, 64, 65, 500, 0, 3])
    flat = rng.integers(0, 1 << 64, counts.sum(), dtype=np.uint64)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert simhash.majority(flat, counts).tolist() == [sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in p) * 2 > len(p)) for p in parts]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_big_bucket_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 6, 60).astype(np.uint64)
    fp = np.unique(fp)
    a, b = simhash.bucket_links(np.zeros(len(fp), np.int64), fp, np.arange(len(fp)))
    assert len(a) < len(fp)
    rows = list(zip(range(len(fp)), fp.tolist()))
    want, root = brute_components(rows), list(range(len(fp)))
    for _ in fp:
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = root[y] = min(root[x], root[y])
    assert {i: root[i] for i in range(len(fp))} == want
