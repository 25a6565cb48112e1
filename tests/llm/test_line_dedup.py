"""Line deduplication against a comparison of all pairs of lines."""

import random

from metricwatch.llm import common, line_dedup

SCHEMA = "doc_id long, text string, n_chars int, h string, line string"


def distance_at_most_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, min_words=5):
    lines = [
        ((d is not None, d or 0, i), line.encode().split())
        for d, text in rows for i, line in enumerate((text or "").split("\n"))
    ]
    lines = [(p, w) for p, w in lines if w]

    def repeats(v, w):
        return v == w or min(len(v), len(w)) >= min_words and distance_at_most_one(v, w)

    gone = {p + (tuple(w),) for p, w in lines if any(q < p and repeats(v, w) for q, v in lines)}
    out = []
    for d, text in rows:
        if text is not None:
            own = [(i, line) for i, line in enumerate(text.split("\n"))]
            text = "\n".join(line for i, line in own if (d is not None, d or 0, i, tuple(line.encode().split())) not in gone)
        out.append((d is not None, d or 0, text is not None, text or ""))
    return sorted(out)


def rows_of():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "ß", "été", "x1", "a", "b", "c", "long-word"])
    base = [[word() for _ in range(rng.randint(3, 12))] for _ in range(12)]
    texts = []
    for _ in range(90):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2) or ["k"]
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", " \n a b", " ".join(["w%d" % i for i in range(3000)]), " ".join(["w%d" % i for i in range(3000) if i != 77])]
    rows = list(enumerate(texts))
    return rows + [(3, texts[3]), (None, texts[5]), (None, None), (6, "one two three four five\none two three four six")]


def test_matches_all_pairs(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, len(t or ""), "h", "l") for d, t in rows], SCHEMA).repartition(5)
    found = line_dedup.dedup_lines(df)
    assert found.schema.names == df.schema.names
    kept = found.collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in kept) == plain(rows)
    assert all(r.n_chars == len(r.text or "") for r in kept)


def test_slices_hold_whole_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_BYTES", 100)
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = line_dedup.dedup_lines(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in kept) == plain(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_workers_get_small_batches(spark, monkeypatch):
    before, written, during = spark.conf.get(common.BATCH_SETTING), line_dedup.written, {}

    def noted(df, label):
        during[label] = spark.conf.get(common.BATCH_SETTING)
        return written(df, label)

    monkeypatch.setattr(line_dedup, "written", noted)
    line_dedup.dedup_lines(spark.createDataFrame(rows_of(), "doc_id long, text string")).count()
    assert {during["lines-hashed"], during["lines-candidates"]} == {str(common.BATCH_BYTES)}
    assert spark.conf.get(common.BATCH_SETTING) == before


def test_batches_are_bounded_in_bytes(spark):
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some words ', 500) AS text")  # 16 MB in one partition
    sized = common.map_batches(texts, lambda b: b.from_pydict({"bytes": [b.nbytes]}), "bytes long")
    with common.small_batches(spark):
        found = [r.bytes for r in sized.collect()]
    assert sum(found) > 15 << 20 and max(found) < common.BATCH_BYTES + (1 << 20)


def noted_tables(monkeypatch, note):
    """What ``note`` finds in each table that the operator writes, by its label."""
    written, found = line_dedup.written, {}

    def noted(df, label):
        out = written(df, label)
        found[label] = note(out)
        return out

    monkeypatch.setattr(line_dedup, "written", noted)
    return found


def test_lines_have_few_half_keys(spark, monkeypatch):
    found = noted_tables(monkeypatch, lambda df: df.selectExpr("avg(size(keys))").first()[0] if "keys" in df.columns else None)
    texts = [" ".join(f"w{n}_{i}" for i in range(n)) for n in range(5, 200)]
    line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert found["lines-hashed"] < 2.7  # four a line in former code


def test_variants_lack_words_outside_shared_halves(spark, monkeypatch):
    found = noted_tables(monkeypatch, lambda df: [len(r.variants) for r in df.collect()] if "variants" in df.columns else None)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:2500] + words[2501:]), " ".join(["x"] + words[1:])]
    kept = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in kept} == {0: texts[0], 1: "", 2: ""}
    # The first line has partners on both sides, the others on one each; 3001 and 3000 variants in former code.
    assert sorted(found["lines-candidates"])[1] < 1700


def test_single_variants_move_no_further(spark, monkeypatch):
    found = noted_tables(monkeypatch, lambda df: df.count())
    same = " ".join(f"w{i}" for i in range(20))
    texts = [f"{same} " + " ".join(f"{d}_{i}" for i in range(20)) for d in range(20)] + [f"{same} one", f"{same} two"]
    line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert found["lines-candidates"] >= 20 and found["lines-variants"] == 2  # former code moved every variant four times


def test_lines_are_parted_like_text(monkeypatch):
    rng = random.Random(1)
    bits = [b"a", b"bb", b"ccc", "\u00e9".encode(), b" ", b" ", b" ", b"  ", b"\t", b"\n", b"\r\n", b"\x1c"]
    texts = [b"".join(rng.choices(bits, k=rng.randint(0, 200))) for _ in range(150)] + [b"", b"\n", b" x", b"x \n"]

    def keys(words):
        plain = b" ".join(words)
        for k in line_dedup.parts(len(words)):
            before, behind = b" ".join(words[:k]), b" ".join(words[len(words) - k :])
            yield from line_dedup.half_keys(plain, [len(before)], [len(plain) - len(behind)])

    for size in (1 << 18, 30):
        monkeypatch.setattr(line_dedup, "PIECE_BYTES", size)
        for least in (1, 5):
            found = [
                (rows[i], numbers[i], digest, own)
                for rows, numbers, piece in line_dedup.pieces(texts) for i, digest, own in line_dedup.hashed_lines(piece, least)
            ]
            assert found == [
                (row, i, line_dedup.xxh3_128_digest(b" ".join(words)), [*keys(words)] if len(words) >= least else [])
                for row, text in enumerate(texts) for i, line in enumerate(text.split(b"\n")) if (words := line.split())
            ]


def test_within_one_word():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.choices([b"a", b"b"], k=rng.randint(0, 6))
        b = rng.choices([b"a", b"b"], k=rng.randint(0, 6))
        assert line_dedup.within_one_word(a, b) == distance_at_most_one(a, b), (a, b)


def test_misleading_hashes_hide_no_link(spark):
    """The earliest line of the last one's groups is no partner of it, the next one is."""
    place = "struct<doc_id: long, line: long, text_key: long>"
    rows = [((0, 0, 0), [0, 1], [10, 7], "z y x w v"), ((1, 0, 0), [0, 2], [11, 5], "a b c d e"), ((2, 0, 0), [0, 1, 2], [12, 7, 5], "a x c d e")]
    candidates = spark.createDataFrame(rows, f"place {place}, gaps array<int>, variants array<long>, text string")
    assert [(r.place.doc_id, r.earlier.doc_id) for r in line_dedup.near_links(candidates).collect()] == [(2, 1)]
