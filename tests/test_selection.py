"""Radix selection against sorted values."""

import math
import random

import numpy as np
import pytest

from metricwatch.operators import selection, stats

INF, NAN = math.inf, math.nan


def order(v):
    return (math.isnan(v), v if not math.isnan(v) else 0.0)


def columns_of(seed):
    rng = random.Random(seed)
    some = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1e308, -1e308, INF, -INF, NAN, 2**53 + 1.0]
    return {
        "ints": [float(rng.randint(-5, 5)) for _ in range(401)],
        "near": [1.0 + rng.randint(0, 9) * 2**-52 for _ in range(401)],
        "wild": [rng.choice(some) if rng.random() < 0.3 else rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(401)],
        "gaps": [None if rng.random() < 0.6 else rng.gauss(0, 1) for _ in range(401)],
        "one": [3.25] + [None] * 400,
        "none": [None] * 401,
    }


def test_keys_keep_the_order():
    values = np.array([-INF, -1e308, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e308, INF, NAN])
    keys = selection.ordered_bits(values)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert selection.from_ordered_bits(keys).tolist()[:-1] == values.tolist()[:-1]
    assert selection.ordered_bits(np.array([-0.0]))[0] == selection.ordered_bits(np.array([0.0]))[0]
    assert selection.ordered_bits(np.array([-NAN]))[0] == keys[-1]


@pytest.mark.parametrize("few", [0, 60, 100_000])
def test_every_rank(spark, few):
    data = columns_of(few)
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in names)).repartition(5)
    plain = {k: sorted((v for v in data[c] if v is not None), key=order) for k, c in enumerate(names)}
    ranks = {k: {0, len(v) // 3, len(v) // 2, len(v) - 1} for k, v in plain.items() if v}
    found = selection.order_statistics(df, ranks, few)
    assert len(found) == sum(map(len, ranks.values()))
    for (k, r), value in found.items():
        assert value == plain[k][r] or math.isnan(value) and math.isnan(plain[k][r])


def test_describe_like_numpy(spark):
    data = columns_of(9)
    df = spark.createDataFrame(list(zip(data["ints"], data["gaps"], data["none"])), "`a.b` double, gaps double, none double")
    got = {(r["column"], r["stat"]): r["value"] for r in stats.describe(df).collect()}
    assert {c for c, _ in got} == {"a.b", "gaps"}
    for column, values in (("a.b", data["ints"]), ("gaps", [v for v in data["gaps"] if v is not None])):
        assert got[column, "count"] == len(values)
        for stat, p in (("min", 0), ("25%", 25), ("50%", 50), ("75%", 75), ("max", 100)):
            assert got[column, stat] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-15)
        assert got[column, "std"] == pytest.approx(np.std(values, ddof=1))


def test_describe_of_an_empty_table(spark):
    assert stats.describe(spark.createDataFrame([], "a double, b long")).count() == 0
