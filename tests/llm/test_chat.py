"""Chat windows: exact round trip, budgets, history and masks."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from metricwatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block long, tokens int"
ODD = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "\\<|im_end|>\\\\", "<\\|im_start|>", "[\\/INST]", "<", "<|im_start|", "", None, "a\nb", "<<SYS>>x<</SYS>>", "ünï 🙂"]
TOKEN = re.compile(r"[^\W\d_]+|\d|[^\x00-\x20\w]|_")


def rows_of():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    rows = []
    for c in range(40):
        n = rng.randint(1, 30)
        for t in range(n):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool\n<x>", "100%", None])
            text = rng.choice(ODD) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(0, 120)))
            rows.append((c, t, role, text, 1, 2))
    rows += [(50, t, ["system", "user", "assistant"][t % 3 if t else 0], f"turn {t}", 1, 2) for t in range(2500)]
    rows += [(51, 0, "assistant", "long " * 20_000, 1, 2), (52, 3, "user", "same", 1, 2), (52, 3, "user", "same", 1, 2)]
    return rows + [(None, 0, "user", "no id", 1, 2), (None, None, "assistant", "no turn", 1, 2)]


def ordered(rows):
    out = {}
    for c, t, role, text, _, _ in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = {r.conv_id: r for r in chat.digests(df, budget=200, history=60).collect()}
    for c, turns in ordered(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), sha(loss))
    assert len(found) == len(ordered(rows))


def test_windows(spark):
    rows = rows_of()
    budget, history = 200, 60
    turns = ordered(rows)
    by_conv = {}
    for w in chat.windows(spark.createDataFrame(rows, SCHEMA), budget, history).collect():
        by_conv.setdefault(w.conv_id, []).append(w)
    for c, own in by_conv.items():
        own.sort(key=lambda w: (w.block, w.window))
        heads = [f"<|im_start|>{r}" for r, _ in turns[c] if "<" not in r and "%" not in r and "\n" not in r]
        done, many = 0, len(turns[c]) > 1
        for w in own:
            parts = w.formatted.split("<|im_start|>")[1:]
            assert len(parts) == w.repeated + w.turns
            assert w.tokens <= budget or w.turns == 1
            if done and turns[c][0][0] == "system" and many:
                assert parts[0].startswith("system\n") and w.repeated >= 1
            assert [p.split("\n")[0] for p in parts[w.repeated :]] == [
                r.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C") for r, _ in turns[c][done : done + w.turns]
            ]
            # Masked spans start behind the headers of new assistant turns.
            assert len(w.loss) == sum(r == "assistant" for r, _ in turns[c][done : done + w.turns])
            for m in w.loss:
                assert w.formatted[: m.start].endswith("<|im_start|>assistant\n") and w.formatted[m.start + m.length :].startswith("<|im_end|>")
            done += w.turns
        assert done == len(turns[c]) and heads is not None


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.windows(empty).count() == 0 and chat.digests(empty).count() == 0


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    back = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("b"), chat.unescaped_role(chat.escaped_role(F.col("t"))).alias("r"))
    for r in back.collect():
        assert r.t == r.b == r.r
        assert not re.search(r"<\|im_(start|end)\|>|\[/?INST\]|</?s>", r.e)


def plain_windows(turns, budget, history):
    """Strings of a conversation's windows, turn by turn, without blocks."""
    pieces = [f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in turns]
    cost = [len(TOKEN.findall(p)) for p in pieces]
    led = turns[0][0] == "system"
    again = cost[0] if led else 0
    out, h, s = [], 0, 0
    for i in range(1, len(turns) + 1):
        if i < len(turns) and sum(cost[h : i + 1]) + (0 if led and s == 0 else again) <= budget:
            continue
        out.append((pieces[0] if led and s else "") + "".join(pieces[h:i]))
        if i < len(turns):
            fits = (j for j in range(led, i) if sum(cost[j:i]) <= history and again + sum(cost[j : i + 1]) <= budget)
            h, s = next(fits, i), i
    return out


def test_windows_reach_over_blocks(spark):
    rng = random.Random(5)
    rows = []
    for c, first in enumerate((0, 1020, 0)):
        for t in range(first, first + 2100):
            role = "system" if c == 0 and t == first else ["user", "assistant"][t % 2]
            rows.append((c, t, role, " ".join(["word"] * (rng.randint(0, 150) if t % 40 == 23 else rng.randint(0, 12))), 1, 2))
    rows += [(3, 0, "system", "rules", 1, 2)] + [(3, t, "user", "hi", 1, 2) for t in range(1022, 1026)] + [(4, None, "user", "a", 1, 2), (4, 0, "assistant", "b", 1, 2)]
    turns = ordered(rows)
    own = {}
    for w in chat.windows(spark.createDataFrame(rows, SCHEMA), 200, 60).collect():
        own.setdefault(w.conv_id, []).append((w.block, w.window, w.formatted))
    assert {c: [f for _, _, f in sorted(x)] for c, x in own.items()} == {c: plain_windows(x, 200, 60) for c, x in turns.items()}
