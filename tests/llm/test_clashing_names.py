"""Columns of the caller that are named like an operator's own ones keep their values and change no result."""

import pytest
from pyspark.sql import functions as F

from metricwatch.llm import line_dedup, line_quality, mixing, simhash

NAMES = ["__id", "__key", "__own", "__OWN_", "__text_key", "__copies", "__u", "__source", "__gone", "__n", "__host", "__left", "__lines", "__text", "shielded_0", "h", "line"]
OPERATORS = {
    "dedup_lines": line_dedup.dedup_lines,
    "keep_one": simhash.keep_one,
    "mix": mixing.mix,
    "clean": lambda docs, **named: line_quality.clean(docs, max_docs=2, **named),
}


def rows_of():
    line = "this line of nine words stands in many texts"
    rows = [(i, f"{line}\nown words of text number {i} " + " ".join(f"w{i}x{k}" for k in range(12)), f"s{i % 2}") for i in range(8)]
    return rows + [(3, rows[3][1], "s1"), (20, None, None), (21, "", "s0"), (None, "a text without an id", "s0")]


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_stay(spark, name):
    plain = spark.createDataFrame(rows_of(), "doc_id long, text string, source string")
    wide = plain.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])
    want, found = OPERATORS[name](plain), OPERATORS[name](wide)
    assert [c for c in found.columns if c not in NAMES] == want.columns
    assert [c for c in found.columns if c in NAMES] == NAMES
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    kept = found.collect()
    assert sorted(map(key, found.select(*want.columns).collect())) == sorted(map(key, want.collect()))
    assert kept and all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for r in kept for n in NAMES)


def test_parameters_may_name_such_columns(spark):
    plain = spark.createDataFrame(rows_of(), "doc_id long, text string, source string")
    renamed = plain.withColumnRenamed("source", "__source")
    for operator, named in ((mixing.mix, "source"), (OPERATORS["clean"], "host")):
        want = operator(plain).collect()
        found = operator(renamed, **{named: "__source"})
        assert "__source" in found.columns
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, (tuple(r) for r in want)))
