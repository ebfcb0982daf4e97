import random
from itertools import combinations

from vellum.llm import decontam


def brute(text, item):
    """Whether any alignment of the item on the text has four fifths equal words, over the item or a stretch."""
    t, n = decontam.folded_words(text), decontam.folded_words(item)
    if not n:
        return False
    for shift in range(-len(n), len(t)):
        same = [0 <= shift + j < len(t) and t[shift + j] == n[j] for j in range(len(n))]
        inside = [0 <= shift + j < len(t) for j in range(len(n))]
        if sum(same) >= 0.8 * len(n) - 1e-9:
            return True
        for a in range(len(n)):
            score = 0
            for b in range(a, len(n)):
                if not inside[b]:
                    break
                score += 1 if same[b] else -4
                if b - a + 1 >= min(12, len(n)) and score >= 0:
                    return True
    return False


def test_masks_find_every_window_of_four_fifths():
    """Any 15 words with up to three replaced leave a mask untouched."""
    for n in range(4):
        for lost in combinations(range(15), n):
            assert any(not any(at + o in lost for o in mask) for mask in decontam.MASKS for at in range(15 - mask[-1]))


def _cases():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(12)]
    items += [(50, "too short item"), (51, ""), (52, None), (53, items[0][1]), (54, "lone"), (55, "What is the capital"), (56, "one two")]
    docs = []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            passage = items[i % 12][1].split()
            for k in rng.sample(range(len(passage)), int(len(passage) * rng.choice([0, 0.1, 0.2, 0.5]))):
                passage[k] = "other"
            if i % 5 == 0:
                passage = passage[: len(passage) // 2]
            at = rng.randrange(len(base) + 1)
            base = base[:at] + [w.upper() + "," for w in passage] + base[at:]
        docs.append((i, " ".join(base)))
    docs += [(70, "ask: what is the CAPITAL? none"), (71, "what is a capital one or two"), (72, "one, two lone"), (73, "too short items"), (74, "x " * 300 + items[2][1])]
    return docs + [(None, items[3][1]), (77, None), (88, ""), (88, "")], items


def test_leaks_match_brute_force(spark):
    docs, items = _cases()
    d = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], "doc_id long, text string, item string, similarity double")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    for chars in (10**6, 900):
        got = {(r["id"], r["item"]) for r in decontam.find_leaks(d, b, block_chars=chars).collect()}
        want = {(i, k) for i, t in docs for k, x in items if t and x and brute(t.encode(), x.encode())}
        assert got == want and want
    kept = decontam.drop_leaking(d, b)
    assert kept.columns == d.columns
    bad = {i for i, _ in want}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_stock_phrase_in_many_items_is_bounded(monkeypatch):
    """Thousands of items that begin alike, in texts that repeat the phrase."""
    phrase = "choose the best answer to the question below"
    index = decontam.SeedIndex([(k, (f"{phrase} " + " ".join(f"i{k}x{j}" for j in range(12))).encode()) for k in range(3000)])
    widest = []
    plain = index._verify
    monkeypatch.setattr(decontam, "HITS", 20_000)
    monkeypatch.setattr(index, "_verify", lambda f, b, e, t, i, s: widest.append(len(i)) or plain(f, b, e, t, i, s))
    texts = [f"{phrase} nothing else. ".encode() * 5, f"{phrase} ".encode() * 5 + " ".join(f"i7x{j}" for j in range(12)).encode()]
    assert [(int(t), index.ids[int(i)]) for t, i, *_ in index.search(texts)] == [(1, 7)]
    assert len(widest) > 5 and max(widest) <= 20_000


def test_very_long_text():
    item = " ".join(f"i{k}" for k in range(30))
    index = decontam.SeedIndex([(1, item.encode()), (2, b"x")])
    found = index.search([("y " * 300_000 + item).encode(), b"", ("y " * 300_000).encode()])
    assert found.tolist() == [[0, 0, 300_000, 30, 30]]


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.find_leaks(d.limit(0), b).collect() == []
    assert decontam.find_leaks(d, b.limit(0)).collect() == []
    assert decontam.find_leaks(d, b).collect()[0]["similarity"] == 1.0
