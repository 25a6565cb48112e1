"""Packing: tokens against the tokenizer itself, and an exact round trip."""

import json
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from metricwatch.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start long, row string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts_of():
    rng = random.Random(2)
    odd = ["it's", "DON'T.", "x.y,z", "Ünïcode", "é", "́a", "a b", "\x1c", "İI", "ΟΔΟΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "12ab,", "日本語。", "🙂", " x", "ab..", ".", ",", "A.", "ſ's"]
    word = lambda: rng.choice(odd) if rng.random() < 0.3 else "".join(rng.choice("abcdeABC.,ß") for _ in range(rng.randint(1, 8)))
    texts = [rng.choice([" ", "\n", "\t ", "\x0b"]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return texts + [None, "", "   ", "long " * 30_000, "y" * 9_000]


def test_word_lookup_is_the_tokenizer(tokenizer):
    table = Path("/root/testdata/sf0.001/documents.parquet")
    texts = [t or "" for t in texts_of()] + pq.read_table(table, columns=["text"])["text"].to_pylist()
    ranks = packing.merge_ranks(PATH)
    assert ranks
    for ours in [packing.WordTokens(PATH, r, limit) for r in (None, ranks) for limit in (50, 10**6)] * 2:
        found = ours.ids([t.encode() for t in texts])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_texts_are_encoded_at_once(tokenizer):
    rng = random.Random(3)
    parts = [chr(i) for i in range(256)] + ["'s", "'re", "'LL", "''", "<|endoftext|>", "\u2019", "\u212a", "\u0178", "\u65e5", "123", "ab", "'", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [chr(i) + end for i in range(256) for end in ("'s", "a", "1", "!", "'", "")] + ["w\u00f6rd \u2019x " * 200_000]
    ours = packing.WordTokens(PATH, packing.merge_ranks(PATH))
    found = ours.ids([t.encode() for t in texts])
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # Words in Latin-1 are not looked up one by one, however many there are.
    ours = packing.WordTokens(PATH, packing.merge_ranks(PATH))
    ours.ids([" ".join(f"Word{i}, it's ({i}) d\u00e9j\u00e0" for i in range(1000)).encode()])
    assert not ours.known


def test_other_splits_go_word_by_word(tmp_path):
    given = json.loads(Path(PATH).read_text(encoding="utf-8"))
    for key, other in (("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel"}), ("added_tokens", [{**given["added_tokens"][0], "normalized": True}])):
        (tmp_path / key).write_text(json.dumps({**given, key: other}), encoding="utf-8")
        assert packing.merge_ranks(str(tmp_path / key)) is None


def test_round_trip(spark, tokenizer):
    texts = texts_of()
    rows = [(i, t, 5, "r") for i, t in enumerate(texts)] + [(3, texts[3], 5, "r"), (None, "no id", 5, "r"), (7, "other text", 5, "r")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6), PATH).collect()
    expected = sorted(((r[0] is None, r[0] or 0), tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)
    by_row, by_sequence = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_row.setdefault((p.doc_id is None, p.doc_id or 0, p.row), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    ours = []
    for (null, i, _), parts in by_row.items():
        parts.sort()
        ids = [x for _, own, _ in parts for x in own]
        assert [s for s, _, _ in parts] == np.cumsum([0] + [len(own) for _, own, _ in parts])[:-1].tolist()
        assert {n for _, _, n in parts} == {len(ids)}
        ours.append(((null, i), ids))
    assert sorted(ours) == expected
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or k == len(by_sequence) - 1
    df = packing.sequences(spark.createDataFrame(pieces[:0] or pieces)).collect()
    assert sorted(len(r.ids) for r in df)[1:] == [4 * 2048] * (len(by_sequence) - 1)


def test_curve_visits_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.curve_keys((cells + 0.5) / 8)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
