"""Toxicity: held-out accuracy, word sums against whole-text counts, odd rows."""

import zlib

import numpy as np

from metricwatch.llm import toxicity

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = toxicity.score(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
    rows = found.join(labels.where("toxic IS NOT NULL"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.85 * sum(r.toxic for r in held)
    assert hits >= 0.9 * sum(r.predicted for r in held)


def test_word_sums_are_text_counts():
    settings = toxicity.Settings(bits=12)
    rng = np.random.default_rng(0)
    ratio, weight = rng.normal(size=1 << 12), rng.normal(size=1 << 12)
    model = toxicity.Model(settings.scale * ratio * weight, np.abs(ratio), -0.5, -2.0)
    texts = ["a bad Text", "É ß 🙂 word word", "", " ", "x" * 1000, "\x02 \x03b", "one two three " * 500]
    scorer = toxicity.Scorer(model, settings, limit=4)
    for text, score in zip(texts, scorer.scores([t.encode() for t in texts])):
        buckets, counts = toxicity.text_counts(text.encode(), settings)
        scaled = counts * ratio[buckets]
        z = settings.scale * (scaled / max(np.abs(scaled).sum(), 1e-9) * weight[buckets]).sum() - 0.5 if text.split() else -2.0
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_odd_rows(spark):
    texts = [(i, ("awful nasty " if i % 3 == 0 else "kind gentle ") + f"w{i % 7} thing") for i in range(120)]
    odd = [(500, None), (501, ""), (502, " \n"), (None, "awful nasty"), (3, "awful nasty w3 thing"), (503, "kind gentle " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts + odd], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, labels).collect()
    assert len(found) == len(texts + odd)
    for r in found:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 120:
            assert r.predicted == int(r.doc_id % 3 == 0)
    blank = {r.score for r in found if r.doc_id in (500, 501, 502)}
    used = [i % 3 == 0 for i in (*range(120), 3) if zlib.crc32(str(i).encode()) % 4 != 2]
    odds = (sum(used) + 1) / (len(used) - sum(used) + 1)
    assert len(blank) == 1 and abs(blank.pop() - odds / (1 + odds)) < 1e-9
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if not r.predicted)
    none = toxicity.score(docs, labels.where("toxic > 5")).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.score(docs.where("doc_id < 0"), labels).count() == 0
