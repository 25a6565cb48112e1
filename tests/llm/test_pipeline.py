"""The pipeline stage by stage against plain versions, on a fixture with copies and odd rows."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_line_dedup import plain as plain_lines
from test_simhash import plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from metricwatch.llm import toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The first small documents, a copy, odd rows, and an extra column."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist() if r["n_chars"] < 3000][:60]
    rows += [(900, rows[3][1], "en", "src1", 1, "x"), (901, None, None, None, None, None), (902, "", "en", "src0", 0, "x"), (None, "no id here at all", "en", "src0", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pq.read_table(f"{SMALL}/labels.parquet").to_pandas()).write.parquet(f"{path}/labels.parquet")
    return path


def steps(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/stage-{i}")
        docs = spark.read.parquet(f"{folder}/stage-{i}")
        out.append((before.collect(), docs.collect(), before.columns, docs.columns))
    return out


def test_stages(spark, folder):
    toxic, lines, near, mixed, packed = steps(spark, folder)
    for before, after, old, new in (toxic, lines, near, mixed):
        assert new == old

    scores = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert sorted(str(r.doc_id) for r in scores if not r.predicted) == sorted(str(r.doc_id) for r in toxic[1])

    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    assert sorted(map(key, lines[1])) == plain_lines([(r.doc_id, r.text) for r in lines[0]])

    prints = {key(r): plain_fingerprint(r.text) for r in near[0]}
    left = [prints[key(r)] for r in near[1]]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(left) for b in left[:i])
    groups = {p: {p} for p in prints.values()}
    for a in list(groups):
        for b in list(groups):
            if (a ^ b).bit_count() <= 2 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for c in groups[b]:
                    groups[c] = groups[a]
    assert len(left) == len({id(g) for g in groups.values()})
    for r in near[1]:
        same = [k for k, p in prints.items() if p in groups[prints[key(r)]] and k[0]]
        assert not same or r.doc_id == min(k[1] for k in same)

    size = {}
    for r in mixed[0]:
        size[r.source or ""] = size.get(r.source or "", 0) + len(r.text or "")
    total, roots = sum(size.values()), sum(math.sqrt(v) for v in size.values() if v)
    expected = []
    for r in mixed[0]:
        chars = size[r.source or ""]
        mean = math.sqrt(chars) / roots * total / chars if chars else 1.0
        name, k, draws = "null" if r.doc_id is None else str(r.doc_id), 0, max(math.ceil(mean / 16), 1)
        for j in range(draws):
            u = int(hashlib.md5(f"{name}:{j}:17".encode()).hexdigest()[:13], 16) / 16**13
            p, n = math.exp(-mean / draws), 0
            level = p
            while u >= level:
                n += 1
                p *= mean / draws / n
                level += p
            k += n
        expected += [key(r)] * k
    assert sorted(map(key, mixed[1])) == sorted(expected)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted((r.doc_id is not None, r.doc_id or 0, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in packed[0])
    rows = {}
    for p in packed[1]:
        rows.setdefault((p.doc_id is not None, p.doc_id or 0, p.row), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    assert sorted((a, b, [x for _, part in sorted(parts) for x in part]) for (a, b, _), parts in rows.items()) == ids
    assert sorted(p.sequence_id * 2048 + p.offset for p in packed[1])[0] == 0
    assert sum(p.length for p in packed[1]) == sum(len(x) for _, _, x in ids)


def test_run_is_the_stages(spark, folder):
    last = steps(spark, folder)[-1][1]
    whole = corpus_pipeline.run(spark, folder).collect()
    own = lambda rows: sorted((str(r.doc_id), r.start, r.length, r.doc_tokens, r.sequence_id, r.offset, bytes(r.ids)) for r in rows)
    assert own(whole) == own(last)


NO_DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, folder, name):
    docs = spark.createDataFrame([], NO_DOCS)
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert found.count() == 0
    assert name == "packing" or found.columns == docs.columns


def test_stages_of_rows_without_values(spark, folder):
    docs = spark.createDataFrame([(None,) * 6] * 3 + [(7, "", "", "", 0, None)], NO_DOCS)
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        rows = found.collect()
        assert all(not r.text for r in rows)
        docs = spark.createDataFrame(rows, NO_DOCS)
        left.append(len(rows))
    # Nothing to learn from, no line to remove, wordless texts are one group; that row is then drawn as often as its source.
    assert left[:3] == [4, 4, 4] and left[3] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert all(r.length == 1 and r.doc_tokens == 1 for r in packed) and len(packed) == left[4]
