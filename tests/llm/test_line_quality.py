"""Quality rules against plain counting."""

import random
import re

from metricwatch.llm import line_quality

SCHEMA = "doc_id long, text string, source string, h long, line string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(" \t\n\x0b\x0c\r").lower()))


def filled(text):
    return [x for x in (text or "").split("\n") if WORD.search(x)]


def plain(rows, max_docs, min_left):
    spread = {}
    for d, text, host in rows:
        for x in filled(text):
            spread.setdefault((host or "", normal(x)), set()).add(d)
    out = []
    for d, text, host in rows:
        words = WORD.findall(text or "")
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)} if len(runs) < 2000 else set()
        lines = filled(text)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        left = [x for x in lines if not (len(spread[host or "", normal(x)]) > max_docs and d != min((i for i in spread[host or "", normal(x)] if i is not None), default=None))]
        thin = bool(lines) and sum(map(len, left)) < min_left * sum(map(len, lines))
        out.append((d is not None, d or 0, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and not thin))
    return sorted(out)


def rows_of():
    rng = random.Random(9)
    word = lambda: rng.choice(["The", "of", "x1", "x2", "été", "#a", "b$", "c"]) + str(rng.randint(0, 60))
    common = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = []
    for i in range(90):
        lines = [rng.choice(common).upper() if rng.random() < 0.2 else rng.choice(common) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(0, 14))]
        rows.append((i, "\n".join(lines), rng.choice(["hot", "hot", "b", None])))
    rows += [(200, None, "hot"), (201, "", None), (202, "\n \t\r\n", "b"), (203, "a b c " * 40, "b"), (204, " ".join(f"w{i}" for i in range(5000)), "b"), (205, "one", "b")]
    return rows


def test_matches_plain_counts(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], SCHEMA).repartition(5)
    found = line_quality.assess(df, max_docs=8, min_left=0.5).collect()
    ours = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found)
    want = plain(rows, 8, 0.5)
    assert ours == want
    assert any(not w[7] and not w[8] for w in want) and any(w[8] for w in want)


def test_repeated_rows_and_missing_ids(spark):
    rows = rows_of()
    extra = [(3, rows[3][1], rows[3][2]), (None, rows[5][1], "b"), (None, None, None)]
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows + extra], SCHEMA)
    found = line_quality.assess(df, max_docs=8, min_left=0.5).collect()
    assert len(found) == len(rows) + 3
    same = [tuple(r) for r in found if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]


def test_clean(spark):
    rows = [(i, f"Shared  line {i}\nown text {'abcdefghij'[i] * 30}", "h") for i in range(10)] + [(20, "shared line 7", "h"), (21, None, "h"), (22, "", None)]
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], SCHEMA)
    found = {r.doc_id: r.text for r in line_quality.clean(df, max_docs=5).collect()}
    assert found[0] == rows[0][1]
    assert all(found[i] == f"own text {'abcdefghij'[i] * 30}" for i in range(1, 10))
    assert 20 not in found and found[21] is None and found[22] == ""


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_quality.assess(empty).count() == 0 and line_quality.clean(empty).count() == 0


def test_limits_of_the_query_grow_with_the_host(spark):
    """A host of 1500 documents removes lines of 16 documents on, one of 40 those of 11 on; texts made of them go."""
    own = lambda host, i: " ".join(f"{host}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    shared = lambda name: " ".join(f"{name}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    groups = {"big": {"often": 16, "seldom": 15}, "small": {"often": 11, "seldom": 10}}
    rows, doc = [], 0
    for host, size in (("big", 1500), ("small", 40)):
        names = [name for name, n in groups[host].items() for _ in range(n)]
        for i in range(size):
            rows.append((doc, shared(host + names[i]) if i < len(names) else own(host, i), host))
            doc += 1
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], SCHEMA).repartition(5)
    found = {r.doc_id: r for r in line_quality.assess(df).collect()}
    assert len(found) == 1540 and not any(r.base_failed for r in found.values())
    # The first document with a line keeps it.
    gone = [d for d, r in found.items() if not r.kept]
    assert sorted(gone) == [*range(1, 16), *range(1501, 1511)]
    left = {r.doc_id for r in line_quality.clean(df).collect()}
    assert left == set(found) - set(gone)
