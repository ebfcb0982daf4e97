"""Every pipeline stage on its own input, and all of them in turn."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_nearcopies import brute_kept
from vellum.llm import secrets


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st"]) for _ in range(rng.randrange(1, 5)))
    body = lambda n: [word() for _ in range(n)]
    item = " ".join(f"q{k}" for k in range(20))
    rows, labels = [], []
    for i in range(240):
        words = body(rng.randrange(40, 120))
        if i % 4 == 0:
            words[5:5] = ["vilk" + word(), "vilk" + word(), "vilk" + word()]
        labels.append((i, i % 2, int(i % 4 == 0)))
        rows.append((i, " ".join(words)))
    rows += [(500, rows[1][1]), (501, rows[1][1].upper().lower()), (502, " ".join(body(30) + [item] + body(30))), (503, f"{' '.join(body(50))} password=abcdef123456xyz")]
    rows += [(None, None), (504, None), (505, "long " * 3000)]
    spark.createDataFrame([(i, t, "en", f"s{k % 3}", None if t is None else len(t), "extra", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, cell string, score int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda d: Counter(r["doc_id"] for r in d.select("doc_id").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        kept[name] = out
    everything = ids(docs)
    gone = everything - ids(kept["toxicity"])
    toxic = {i for i in range(0, 240, 4)}
    assert len(set(gone) & toxic) >= 0.9 * len(toxic) and len(set(gone) - toxic) <= 0.05 * 240
    copies = everything - ids(kept["simhash_dedup"])
    stays = {i for i, _ in brute_kept([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])}
    assert set(copies) == {i for i in everything if i is not None} - stays and {500, 501} <= set(copies)
    assert everything - ids(kept["decontamination"]) == Counter([502])
    clean = {r["doc_id"]: r["text"] for r in kept["secret_redaction"].collect()}
    assert set(clean) == set(everything) and clean[503].endswith(secrets.PLACEHOLDER)
    assert sum(t != u for t, u in zip(clean.values(), (r["text"] for r in docs.collect()))) == 1


def test_run(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    left = {r["doc_id"] for r in packed}
    assert not left & {500, 501, 502} and {1, 503, None} <= left
    bins = Counter()
    for r in packed:
        bins[r["cell"], r["bin"]] += r["tokens"]
    assert max(bins.values()) <= 2048


def test_empty(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
