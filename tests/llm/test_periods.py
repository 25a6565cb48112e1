"""Runs against a plain search over every period and place."""

import random
from hashlib import sha256

import numpy as np
import pytest

from metricwatch.llm import periods

SCHEMA = "doc_id long, text string, start string, runs string"


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            stop = i
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            if stop - i + q >= max(6, 4 * q) and not any(a <= i and stop + q <= a + m for a, m, _ in found):
                found.append((i, stop - i + q, q))
            i = stop + 1
    return sorted(found)


def plain_row(doc_id, text, plant):
    words = (text or "").encode().split()
    words = [words[i].decode() for i in periods.planted(doc_id, len(words))] if plant else [w.decode() for w in words]
    runs = plain_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (
        (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        + (collapsed, sha256(listed.encode()).hexdigest(), sha256(collapsed.encode()).hexdigest())
    )


def rows_of():
    rng = random.Random(5)
    rows = []
    for i in range(300):  # few words, so that periods nest, touch and overlap
        letters = "abc"[: 1 + i % 3]
        words = []
        while len(words) < i:
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 40))]
            words += piece * rng.randint(1, 6)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "", ""))
    unit = [str(k) for k in range(700)]
    rows += [
        (1000, " ".join(unit * 5 + unit[:99]), "", ""), (1001, " ".join(["x"] + unit * 3 + unit[:699]), "", ""),
        (1002, "a " * 3000, "", ""), (1003, "a " * 1500 + "b " + "a " * 1500, "", ""), (1004, None, "", ""), (None, "a b " * 20, None, None),
        (1005, "", "", ""), (1006, " \n\x0b", "", ""), (1007, "a b " * 9 + "é ü é ü é ü é ü", "", ""), (7, "a a a a a", "", ""),
        (1002, "a " * 3000, "", ""), (1008, "\x1c ".join(["a"] * 8), "", ""),
    ]
    return rows


@pytest.mark.parametrize("plant", [False, True])
def test_matches_every_period_and_place(spark, plant):
    rows = rows_of()
    found = periods.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), plant)
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    ours = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed, r.runs_sha256, r.collapsed_sha256) for r in found.collect()), key=key)
    assert ours == sorted((plain_row(r[0], r[1], plant) for r in rows), key=key)


@pytest.mark.parametrize("width", [1, 2, 8, 64, 1024])
def test_convolution_is_exact(width):
    rng = np.random.default_rng(width)
    blocks = rng.integers(0, 10**6, (3, width)).astype(np.uint64)
    behind = rng.integers(0, 10**6, (3, 2 * width)).astype(np.uint64)
    behind[1, width // 2 : width // 2 + width] = blocks[1]
    plain = [
        [sum((int(a) - int(b)) ** 2 for a, b in zip(x, y[d : d + width])) % periods.PRIME for d in range(width)]
        for x, y in zip(blocks, behind)
    ]
    assert periods.squared_differences(blocks, behind).tolist() == plain
    assert plain[1][width // 2] == 0
    wide = rng.integers(0, periods.PRIME, (2, 2 * width)).astype(np.uint64)
    assert (periods.back(periods.transform(wide)) == wide).all()


def test_scales_agree_with_direct_sums(monkeypatch):
    rng = random.Random(3)
    texts = [np.array(rng.choices([1, 2], k=50) * 6 + rng.choices([1, 2, 3], k=200) + [4] * 30) for _ in range(20)]
    x, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    expected = {k: plain_runs(t.tolist()) for k, t in enumerate(texts)}
    for limit in (1, 8, 1 << 20):
        monkeypatch.setattr(periods, "DIRECT_BELOW", limit)
        monkeypatch.setattr(periods, "CELLS", 64 if limit == 1 else 1 << 20)
        assert periods.find_runs(x, sizes) == expected


def test_empty_table(spark):
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
