import math
import random
import zlib
from collections import Counter

from vellum.llm import langid
from vellum.llm.queries import op2_langid

STEMS = {"aa": ["kal", "mor", "tis"], "bb": ["zug", "hef", "wol"], "cc": ["éla", "oui", "que"]}


def text_of(lang, rng, n=30):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, n=240):
    rng = random.Random(3)
    rows = [(i, text_of(lang, rng), lang) for i in range(n) for lang in [rng.choice(list(STEMS))]]
    rows += [(9001, None, "aa"), (9002, "12 -- 7!", "bb"), (9003, "KAL mor", None), (9003, "KAL mor", None), (None, "zughef", None), (9004, "x" * 100_000 + " zug", None)]
    return spark.createDataFrame([(i, t, lang, "s", 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_langid(spark, str(tmp_path)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] is None or r["doc_id"] > 9000}
    assert odd >= {(9001, "und"), (9002, "und"), (9003, "aa"), (None, "bb")}


def test_backoff_uses_the_longest_known_grams():
    counts = {0: {"kal": [5, 0], "zug": [0, 5]}, 4: {" kal": [3, 0]}, 3: {"zug": [0, 4]}, 2: {"zz": [1, 9]}, 1: {"k": [9, 1], "z": [1, 9]}}
    model = langid.Model(["aa", "bb"], counts)
    scores = model.unseen(["kalx", "xzugx", "zzz", "k", "ß"])
    assert (scores[0] == model.tables[4][0]).all()
    assert (scores[1] == model.tables[3][0]).all()
    assert (scores[2] == model.tables[2][0]).all()
    assert (scores[3] == model.tables[1][0]).all()
    assert (scores[4] == 0).all()
    langs, score = model.predict(["kal kal", "zug", "ß", "", None, "7"])
    assert langs[:2] == ["aa", "bb"] and langs[3:] == ["und"] * 3 and score[2] == 0.5


def brute(rows, asked):
    """The definition, unit by unit, over counts of all labelled texts."""
    grams = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)] if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    langs = sorted({lang for _, t, lang in rows if t is not None and lang})
    units = {n: {lang: Counter() for lang in langs} for n in range(5)}
    for _, t, lang in rows:
        for w in split(t) if lang else ():
            units[0][lang][w] += 1
            for n in range(1, 5):
                units[n][lang].update(grams(w, n))
    kinds = {n: set().union(*units[n].values()) for n in units}
    log = lambda n, u, lang: math.log((units[n][lang][u] + 0.5) / (sum(units[n][lang].values()) + 0.5 * (len(kinds[n]) + 1)))
    out = []
    for i, t in asked:
        total = dict.fromkeys(langs, 0.0)
        words = split(t)
        for w in words:
            n, found = 0, [w] if w in kinds[0] else []
            for n in (4, 3, 2, 1) if not found else ():
                found = [g for g in grams(w, n) if g in kinds[n]]
                if found:
                    break
            for lang in langs:
                total[lang] += sum(log(n, u, lang) for u in found) / max(len(found), 1)
        top = max(total.values())
        share = {lang: math.exp(v - top) for lang, v in total.items()}
        best = max(langs, key=lambda lang: (share[lang], -langs.index(lang)))
        out.append((i, best, round(share[best] / sum(share.values()), 6)) if words else (i, "und", 0.0))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, tmp_path):
    docs = table(spark)
    rng = random.Random(9)
    odd = [(9100 + i, "".join(rng.choice("kalzugéß \u00bd\u2461x1") for _ in range(12)), None) for i in range(60)] + [(9200, "\u00bd \u2461 \u2167", "aa")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, lang, "s", 1.0) for i, t, lang in odd], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 4
    got = op2_langid(spark, str(tmp_path)).collect()
    want = brute([r for r in rows if fold(r[0]) != 2], [(i, t) for i, t, _ in rows])
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got), key=str) == want
    assert all(r["held_out"] == (fold(r["doc_id"]) == 2) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 9200} == {"und"}


def test_numerals_are_no_letters():
    assert langid.words_of("a\u00bdB \u2167 c\u2461d \u01c5x 7e") == ["a", "b", "c", "d", "\u01c6x", "e"]


def test_nothing_learned(spark):
    docs = table(spark, 5)
    model = langid.learn(docs.filter("false"))
    got = langid.identify(docs, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), model).collect() == []
