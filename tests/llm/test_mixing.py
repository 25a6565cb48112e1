"""Mixing: shares, the inverted distribution and odd rows."""

import math
import random

from metricwatch.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, n_chars long"


def rows_of(n=3000):
    rng = random.Random(1)
    return [(i, "x" * rng.randint(5, 40), rng.choice(["hot", "hot", "hot", "a", "b"]), "c", 1) for i in range(n)]


def shares(rows):
    total = sum(len(r.text) for r in rows)
    return {s: sum(len(r.text) for r in rows if r.source == s) / total for s in {r.source for r in rows}}


def test_meets_weights_and_hashes_alone_decide(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("hot", 1.0), ("a", 1.0), ("b", 2.0)], "source string, weight double")
    found = mixing.mix(df, weights=weights, epochs=2.0).collect()
    assert all(abs(v - w) < 0.03 for v, w in ((shares(found)[s], w) for s, w in (("hot", 0.25), ("a", 0.25), ("b", 0.5))))
    assert abs(sum(len(r.text) for r in found) / sum(len(r[1]) for r in rows) - 2) < 0.1
    keys = [r.shuffle_key for r in found]
    assert keys == sorted(keys)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    again = mixing.mix(df.repartition(7), weights=weights, epochs=2.0).collect()
    assert sorted((r.doc_id, r.copy) for r in again) == sorted((r.doc_id, r.copy) for r in found)


def test_counts_are_poisson(spark):
    df = spark.createDataFrame([(i, "x" * 10, "s", "c", 1) for i in range(8000)], SCHEMA)
    for mean in (0.7, 40.0):
        counts = [r["n"] for r in mixing.repetitions(df, "source", None, 2.0, mean, 3).selectExpr("__copies AS n").collect()]
        average = sum(counts) / len(counts)
        spread = sum((c - average) ** 2 for c in counts) / len(counts)
        assert abs(average - mean) < 5 * math.sqrt(mean / len(counts))
        assert abs(spread / mean - 1) < 0.1
        if mean < 1:
            assert abs(sum(c == 0 for c in counts) / len(counts) - math.exp(-mean)) < 0.02


def test_odd_rows(spark):
    rows = [(1, None, "empty", "c", 1), (1, None, "empty", "c", 1), (2, "", None, "c", 1), (None, "text", "s", "c", 1), (None, "text", "s", "c", 1), (3, "t" * 10**6, "long", "c", 1)]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA), epochs=3.0)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "copy", "shuffle_key"]
    names = [(r.doc_id, r.copy) for r in found.collect()]
    assert all(names.count(n) % 2 == 0 for n in names if n[0] in (1, None))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
