"""Distances of sources against a plain version over every term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from metricwatch.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, tile string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_audit(rows, min_docs, top):
    counts, spread, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source, found = lang or "", source or "", plain_terms(text)
        groups.add((lang, source))
        counts[lang, source].update(found)
        spread[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        vocabulary = [t for t, n in spread[lang].items() if n >= min_docs]
        sources = [s for g, s in groups if g == lang]

        def shares(count):
            total = sum(count[t] for t in vocabulary) + 5 * len(vocabulary)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in vocabulary}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in vocabulary), o) for o in sources if o != s]
            above = [(p[s][t] - q[t], t) for t in vocabulary if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, cap in (("pair", pairs, None), ("term", above, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:cap], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def rows_of():
    rng = random.Random(11)
    vocabulary = [w + s for w in "the of Über naïve ΣΑΣ straße 東京 x".split() for s in ("", "a", "É", "ing")]
    rows = []
    for i in range(300):
        lang, source = rng.choice("ab"), f"s{min(int(rng.expovariate(0.5)), 11)}"
        words = rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 60))
        rows.append((i, rng.choice([" ", "\n", "4", "_-", "\x7f"]).join(words), lang, source, 1, 2, "t"))
    rows += [(None, None, None, None, None, None, None), (1, "", "a", "empty", 0, 0, ""), (2, "12 34", "b", "empty", 0, 0, "")]
    rows += [(3, "only " * 500, "c", f"c{k}", 0, 0, "") for k in range(3)]  # fewer documents than the vocabulary needs
    rows += [(4, "The THE the " + "verylong" * 3000, "a", "s0", 0, 0, "")] * 40  # repeated rows
    return rows + [(5, "ΣΑΣ the", "a", "Ä", 0, 0, ""), (6, "the", "a", "Z", 0, 0, "")]


@pytest.mark.parametrize("tile, levels", [(64, 500_000), (4, 30)])
def test_matches_all_terms(spark, tile, levels):
    rows = rows_of()
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), min_docs=6, top=7, tile=tile, levels_a_part=levels)
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    ours = [tuple(r) for r in found.collect()]
    assert len(ours) == len(set(ours))
    assert set(ours) == plain_audit(rows, 6, 7)


def test_counts_are_those_of_the_texts(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in divergence.term_counts(df.fillna("", ["lang", "source", "text"]).select("lang", "source", "text")).collect()}
    counted = Counter(t for r in rows for t in plain_terms(r[1]))
    sums = Counter()
    for _, _, term, n, _ in whole:
        sums[term] += n
    assert sums == counted


def test_shares_are_exact_beyond_doubles(spark):
    n, total, v = 10**13 + 7, 10**15 + 11, 10**7 + 3
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(divergence.share("n", "total", "v")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
