"""Secrets: base spans against plain rules, the field against enumeration of all taggings."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq

from metricwatch.llm import secrets
from metricwatch.llm.queries import queries

SCHEMA = "doc_id long, text string, base string, h long"
SETTINGS = secrets.Settings(sample_rows=200, rounds=40)


def plain_base(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def texts_of(n=150):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghÄ") for _ in range(rng.randint(2, 8)))
    value = lambda k: "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(k))
    forms = ['password = "{}"', "api_key: {}", "TOKEN={}", "secret :'{}'", "apikey={}"]
    texts = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(0, f"{word()} {rng.choice(forms).format(value(rng.randint(4, 24)))} {word()}")
        if i % 5 == 0:
            lines.append("key AKIA" + "".join(rng.choice("ABCDEF0123456789") for _ in range(rng.randint(5, 20))))
        if i % 7 == 0:
            lines.append("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 60))))
        texts.append("\n".join(lines))
    return texts + [None, "", "\n", "password: token: abcdefgh", "PASSWD=Kabcdefgh", "ſecret=abcdefghi", "z " * 50_000, "a \u00a0 \x85 b \u00a0c"]


def test_base_spans():
    for text in texts_of():
        assert secrets.base_spans(text or "") == plain_base(text or "")


def test_viterbi_is_the_best_of_all_taggings():
    rng = np.random.default_rng(0)
    for _ in range(30):
        scores, steps = rng.normal(size=(rng.integers(1, 7), 3)), rng.normal(size=(4, 3))
        value = lambda tags: steps[3, tags[0]] + sum(scores[t, y] for t, y in enumerate(tags)) + sum(steps[a, b] for a, b in zip(tags, tags[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(scores)), key=value)
        assert tuple(secrets.viterbi(scores, steps)) == best


def test_expectations_are_those_of_all_taggings():
    rng = np.random.default_rng(1)
    sizes = np.array([4, 4, 2, 1])
    scores, steps = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(4, 3))
    at = np.cumsum(sizes) - sizes
    active = [int((sizes > t).sum()) for t in range(4)]
    marginal, counts = secrets._expectations(np.exp(scores), steps, at, sizes, active)
    want, moves = np.zeros_like(marginal), np.zeros((4, 3))
    for a, n in zip(at, sizes):
        tags = list(itertools.product(range(3), repeat=n))
        value = np.array([steps[3, y[0]] + sum(scores[a + t, y[t]] for t in range(n)) + sum(steps[i, j] for i, j in zip(y, y[1:])) for y in tags])
        share = np.exp(value) / np.exp(value).sum()
        for y, p in zip(tags, share):
            moves[3, y[0]] += p
            for t in range(n):
                want[a + t, y[t]] += p
            for i, j in zip(y, y[1:]):
                moves[i, j] += p
    assert np.allclose(marginal, want) and np.allclose(counts, moves)


def test_lines_left_out_have_no_secret():
    field = secrets.fit_field([t or "" for t in texts_of()], SETTINGS)
    tagger = secrets.Tagger(field, limit=500)
    found = 0
    for text in (t or "" for t in texts_of()[:60]):
        data = text.encode()
        tagged = dict(tagger.tags(data, text))
        ids, sizes = tagger.chains(data.split(b"\n"))
        scores = tagger.emissions(ids, sizes) + sum(field.files[f, b] for f, b in enumerate(secrets.file_features(text)))
        at = 0
        for i, n in enumerate(sizes):
            if n:
                best = secrets.viterbi(scores[at : at + n], field.steps)
                assert best.any() == (i in tagged) and (i not in tagged or (best == tagged[i]).all())
                found += best.any()
            at += n
    assert found


def test_adds_values_that_patterns_miss(spark):
    texts = texts_of()
    rows = [(i, t, "b", 1) for i, t in enumerate(texts)] + [(3, texts[3], "b", 1), (None, texts[0], "b", 1), (900, "abc password \"Ab12+Cd34/Ef56aa\" de", "b", 1)]
    found = secrets.scan(spark.createDataFrame(rows, SCHEMA).repartition(4), SETTINGS).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, _, _ in rows if i == r.doc_id) or ""
        assert [(s.start, secrets.KINDS.index(s.kind), s.stop) for s in r.base] == plain_base(text)
        for s in r.added:
            assert 0 <= s.start < s.stop <= len(text) and all(s.stop <= b.start or s.start >= b.stop for b in r.base)
    plain = [r for r in found if r.doc_id is not None and r.doc_id < 150 and r.doc_id % 3 and r.doc_id % 5 and r.doc_id % 7]
    assert sum(len(r.added) for r in plain) == 0


def test_finds_planted_secrets_that_no_pattern_matches():
    """Production settings, fitted on sf0.01: recall on planted lines, and no span in texts without a secret."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    likely = [t for t in texts if secrets.base_spans(t)]
    clean = [t for t in texts if not secrets.base_spans(t)]
    tagger = secrets.Tagger(secrets.fit_field(likely + clean[: len(clean) // 2], secrets.Settings()))
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    forms = ['my credential = "{}"', "auth_key: {}", "passphrase = {}", "pwd={}", "signing -> {}", "Authorization: Bearer {}", "{}"]
    lines = []
    for form in forms:
        for n in (16, 20, 24, 32, 40):
            lines += [(form, "".join(rng.choices(letters, k=n))) for _ in range(10)]
    found = 0
    for form, value in lines:
        line = form.format(value)
        assert not secrets.base_spans(line)
        at = line.index(value)
        found += any(a < at + len(value) and b > at and b - a >= 0.8 * len(value) for a, b in tagger.spans(line.encode(), line))
    assert found >= 0.8 * len(lines), found / len(lines)
    unseen = clean[len(clean) // 2 :]
    wrong = sum(len(tagger.spans(t.encode(), t)) for t in unseen)
    assert wrong <= len(unseen) / 200, wrong
    for line in ("version = 1.2.3", "port: 8080", 'name = "Alexander"', "total: 4068516892505468", "see https://www.example.com/page.html now"):
        assert not tagger.spans(line.encode(), line), line


def test_texts_together_are_tagged_as_alone():
    texts = [t or "" for t in texts_of()]
    field = secrets.fit_field(texts, SETTINGS)
    alone, together = secrets.Tagger(field), secrets.Tagger(field, limit=300)
    want = [alone.spans(t.encode(), t) for t in texts]
    for limit in (1, 2_000, 1 << 20):
        got = []
        for group in secrets._groups([t.encode() for t in texts], limit):
            got += together.spans_of(group, [t.decode() for t in group])
        assert got == want
    assert any(want)


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], SCHEMA), SETTINGS).count() == 0


def test_query_digests(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    found = queries()["op7_crf_secrets"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        base = plain_base(texts[r.doc_id])
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("crf:")] == [s for s in joined.split(",") if s]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert any(r.n_assign or r.n_hex or r.n_access for r in found)
