import random
from collections import Counter, defaultdict

from vellum.llm import packing


def brute(sizes, sources, clusters, capacity, per_source):
    """Looks at every bin for the tightest compatible one; of equal rooms the longest unchanged."""
    bins, out = [], [None] * len(sizes)
    for turn, i in enumerate(sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))):
        fits = [b for b in bins if b["room"] >= sizes[i] and clusters[i] not in b["clusters"] and b["sources"][sources[i]] < per_source]
        if fits:
            best = min(fits, key=lambda b: (b["room"], b["turn"]))
        else:
            best = {"no": len(bins), "room": capacity, "clusters": set(), "sources": Counter()}
            bins.append(best)
        out[i] = best["no"]
        best["room"] -= sizes[i]
        best["turn"] = turn
        best["clusters"].add(clusters[i])
        best["sources"][sources[i]] += 1
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(0, 120)
        sizes = [rng.randrange(1, 65) for _ in range(n)]
        sources, clusters = ([rng.randrange(k) for _ in range(n)] for k in (4, 30))
        bins, offsets = packing.best_fit(sizes, sources, clusters, 64, 2)
        assert bins == brute(sizes, sources, clusters, 64, 2)
        for b in set(bins):
            mine = sorted((offsets[i], sizes[i]) for i in range(n) if bins[i] == b)
            assert mine[0][0] == 0 and all(a + s == c for (a, s), (c, _) in zip(mine, mine[1:])) and sum(mine[-1]) <= 64


def check(docs, got, capacity, per_source):
    lengths = Counter()
    bins = defaultdict(list)
    for r in got:
        lengths[r["id"]] += r["tokens"]
        bins[r["cell"], r["bin"]].append(r)
    assert lengths == Counter({i: sum(len((t or "").split()) + 1 for j, t, _ in docs if j == i) for i in {d[0] for d in docs}})
    sources = {i: s for i, _, s in docs}
    texts = {i: (t or "").lower() for i, t, _ in docs}
    for rows in bins.values():
        assert sum(r["tokens"] for r in rows) <= capacity
        assert max(Counter(sources[r["id"]] for r in rows).values()) <= per_source
        assert max(Counter((texts[r["id"]], r["piece"]) for r in rows).values()) == 1


def test_cells_match_brute_force(spark):
    """The table's bins, cell by cell, are those of a search over all bins with all pieces; a very long text among them."""
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(0, 200))), f"s{rng.randrange(4)}") for i in range(90)] + [(900, "long " * 20_000, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = packing.pack_documents(table, capacity=64, per_source=2, cell_rows=30).collect()
    texts, sources = {i: t for i, t, _ in docs}, {i: s for i, _, s in docs}
    assert len({r["cell"] for r in got}) > 1 and len(got) > 400
    for cell in {r["cell"] for r in got}:
        mine = sorted((r for r in got if r["cell"] == cell), key=lambda r: (r["id"], r["piece"]))
        want = brute([r["tokens"] for r in mine], [sources[r["id"]] for r in mine], [(texts[r["id"]], r["piece"]) for r in mine], 64, 2)
        assert [r["bin"] for r in mine] == want


def test_whole_table(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 70))), f"s{rng.randrange(4)}" if i % 9 else None) for i in range(150)]
    docs += [(1000 + i, "Copy of one text", "hot") for i in range(40)] + [(2000, None, "x"), (2001, "", "x"), (2002, "long " * 500, "x"), (None, "no id", None)]
    table = spark.createDataFrame([(i, t, s, 1, "c") for i, t, s in docs], "doc_id long, text string, source string, bin int, cell string")
    for cell_rows in (1000, 40):
        check(docs, packing.pack_documents(table, capacity=64, per_source=2, cell_rows=cell_rows).collect(), 64, 2)
    assert packing.pack_documents(table.limit(0)).collect() == []
