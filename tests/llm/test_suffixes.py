"""Removed bytes against a dictionary of all windows."""

import random

from metricwatch.llm import suffixes

SCHEMA = "doc_id long, text string, c string, h long"


def plain(rows, length):
    seen, out = {}, []
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            key = data[p : p + length]
            at = (i is not None, i or 0, p)
            seen[key] = min(at, seen.get(key, at))
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] < (i is not None, i or 0, p):
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i is not None, i or 0, len(data), sum(gone), spans, kept))
    return sorted(out)


def check(spark, rows, length=100):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)
    found = suffixes.cut(df, length).collect()
    ours = sorted(
        (r.doc_id is not None, r.doc_id or 0, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found
    )
    assert ours == plain(rows, length)


def test_matches_all_windows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeßé ") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30), prose(60), prose(8), "ab" * 120, "z" * 500]
    rows = []
    for i in range(120):
        parts = [prose(rng.randint(0, 40))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, len(s))
            parts += [s[cut:] if rng.random() < 0.3 else s, prose(rng.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300 + i, rows[5][1]) for i in range(20)]
    rows += [(400, None), (401, ""), (402, "q" * 100), (403, "q" * 99), (404, "q" * 101), (None, rows[7][1]), (7, rows[7][1]), (None, None)]
    check(spark, rows)
    check(spark, rows[::-1], 64)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij") for _ in range(6000))
    monkeypatch.setattr(suffixes, "PIECE", 512)
    found = [suffixes._anchors(d, p, 100) for d, p in suffixes._pieces([b"short", text.encode()], 100)]
    covered = sorted((p - lead, p - tail) for f in found for p, lead, tail in zip(f[1], f[4], f[5]))
    starts = {s for lo, hi in covered for s in range(lo, hi + 1)}
    assert starts == set(range(5901))
    monkeypatch.setattr(suffixes, "PIECE", 1 << 20)
    whole = [suffixes._anchors(d, p, 100) for d, p in suffixes._pieces([text.encode()], 100)]
    assert {p for f in whole for p in f[1].tolist()} == {p for f in found for p in f[1].tolist()}


def test_empty_table(spark):
    assert suffixes.cut(spark.createDataFrame([], SCHEMA)).count() == 0
