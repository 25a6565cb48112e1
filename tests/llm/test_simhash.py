"""SimHash groups against a plain all-pairs version."""

import random

import xxhash
from pyspark.sql import functions as F

from metricwatch.llm import simhash
from metricwatch.llm.common import components

SCHEMA = "doc_id long, text string, source string, root string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(i)] = min(r[0], smallest.get(find(i), r[0]))
    return sorted((r[0] is None, r[0] or 0, p - (p >> 63 << 64), smallest.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints)))


def rows_of():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeÄß") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)]
    base = [word() for _ in range(400)]
    for i in range(80):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(400)] = word()
        texts.append(("\n" if i % 2 else " ").join(copy))
    texts += [None, "", " \n\t", "one", "ONE", "one two", "x" * 50_000, texts[3], texts[3]] + [" ".join(map(str, range(9000)))] * 2
    rows = [(i, t, "s", "r") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "s", "r"), (None, "one", "s", "r"), (None, None, None, None), (5, "other words entirely here", "s", "r")]


def test_matches_all_pairs(spark):
    rows = rows_of()
    for limit in (2, 32):
        found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_limit=limit)
        ours = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in found.collect())
        assert ours == plain_groups(rows)


def test_links_at_every_pair_of_bits(spark):
    base = 0x0123456789ABCDEF
    words = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}
    signed = sorted(w - (w >> 63 << 64) for w in words)
    for limit in (1, 100, 10**6):
        pairs = simhash.close_pairs(spark.createDataFrame([(w,) for w in signed], "fingerprint long"), limit)
        found = components(pairs, "test")
        assert found.select(F.countDistinct("root")).first()[0] == 1
        assert sorted(r.node for r in found.select("node").collect()) == signed


def test_one_of_each_group_stays(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = [plain_fingerprint(r[1]) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    groups = simhash.near_duplicates(df).select("root").distinct().count()
    assert len(prints) == groups


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
