"""Chat formatting into windows of bounded length, with a loss mask over assistant texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.sources import new_folder, written

# The template's control strings, and others that a text must not contain unescaped.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = r"([<\[])(?=\|im_start\||\|im_end\||/?s>|/?INST\]|/?<?/?SYS>|\|endoftext\||\|startoftext\|)"
TOKEN = r"\p{L}+|\p{N}|[^\x00-\x20\p{L}\p{N}]"
# Turns are handled in blocks of this many turn numbers, so a conversation of any length is never one row.
BLOCK = 1024


def escaped(text: Column) -> Column:
    """Doubles backslashes and puts one behind the bracket that opens a control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROLS, r"$1\\")


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``: a doubled backslash is one, a single one was inserted."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escaped_role(role: Column) -> Column:
    """A role on one line, without control strings."""
    for raw, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def unescaped_role(role: Column) -> Column:
    for raw, coded in (("[", "%5B"), ("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def _block() -> Column:
    return F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK), F.lit(-(2**62)))


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation and block of turn numbers, with its turns in order."""
    body = escaped(F.col("text"))
    header = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))
    plain = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    pieces = plain.withColumn("body", body).withColumn("header", header).withColumn(
        "piece", F.concat("header", "body", F.lit(CLOSE + "\n"))
    )
    return pieces.groupBy("conv_id", _block().alias("block")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn", "role", "text", "piece",
                    F.char_length("header").alias("head_chars"),
                    F.char_length("body").alias("body_chars"),
                    F.char_length("piece").alias("chars"),
                    F.regexp_count("piece", F.lit(TOKEN)).alias("tokens"),
                )
            )
        ).alias("turns")
    )


def _with_system(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """Adds the block's number ``step`` of ``steps`` and the conversation's leading system turn.

    ``leads`` is set where the system turn stands, ``system`` where it is to be repeated.
    """
    places = order.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), "step", "steps")
    own = blocks.join(places, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block"))).drop("__conv", "__block")
    leading = own.where("step = 1 AND turns[0].role = 'system'").select(
        F.col("conv_id").alias("__conv"),
        F.expr("turns[0].piece").alias("system"),
        F.expr("turns[0].tokens").cast("long").alias("system_tokens"),
        F.expr("turns[0].chars").cast("long").alias("system_chars"),
    )
    return own.join(leading, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").select(
        "conv_id", "block", "step", "steps", "turns",
        F.coalesce("system", F.lit("")).alias("system"),
        F.coalesce("system_tokens", F.lit(0)).alias("system_tokens"),
        F.coalesce("system_chars", F.lit(0)).alias("system_chars"),
        (F.col("system").isNotNull() & (F.col("step") == 1)).alias("leads"),
    )


def _starts(blocks: DataFrame, budget: int, history: int) -> DataFrame:
    """Adds prefix sums and ``starts``, the windows' first turn ``h`` and first new turn ``s``.

    ``turns`` begin with ``known`` turns of the block before, whose last window is open: it starts at
    ``open``.  The first window has the system turn as a new turn; later ones repeat it before turns h, h + 1, ...
    """
    sums = "aggregate(turns, array(0L), (a, t) -> concat(a, array(element_at(a, -1) + t.{})))"
    summed = blocks.withColumn("token_sums", F.expr(sums.format("tokens"))).withColumn("char_sums", F.expr(sums.format("chars")))
    return summed.withColumn(
        "starts",
        F.expr(
            f"""aggregate(sequence(known, size(turns) - 1), array(open),
            (w, i) -> IF(
                i = 0 OR token_sums[i + 1] - token_sums[element_at(w, -1).h]
                    + IF(leads AND element_at(w, -1).s = 0, 0L, system_tokens) <= {budget},
                w,
                concat(w, array(struct(
                    coalesce(get(filter(sequence(IF(leads, 1, 0), i), j ->
                        token_sums[i] - token_sums[j] <= {history}
                        AND system_tokens + token_sums[i + 1] - token_sums[j] <= {budget}), 0), i) AS h,
                    i AS s)))))"""
        ),
    )


def _chained(blocks: DataFrame, steps: int, budget: int, history: int) -> DataFrame:
    """``_starts`` of conversations of several blocks, one block after the other.

    A block's last window stays open: the next block begins with its turns, and with those that a
    window's history can reach.  Each has a few tokens of the template, so these are few.
    """
    # A folder a step, so that each step reads its own blocks only.
    folder = new_folder(blocks.sparkSession, "chat-blocks")
    blocks.write.partitionBy("step").parquet(folder)
    rest = blocks.sparkSession.read.schema(blocks.schema).parquet(folder)
    done, state = [], None
    for step in range(1, steps + 1):
        own = rest.where(F.col("step") == step)
        if state is None:
            own = own.withColumn("known", F.lit(0)).withColumn("open", F.expr("struct(0 AS h, 0 AS s)"))
        else:
            own = own.drop("leads").join(state, F.col("conv_id").eqNullSafe(F.col("__conv"))).withColumns(
                {"turns": F.expr("concat(tail, turns)"), "known": F.expr("size(tail)")}
            ).drop("__conv", "tail")
        now = written(_starts(own, budget, history), "chat-step")
        done.append(now)
        # From the open window's first turn, or from the first one within a window's history if that is earlier.
        reach = now.where("step < steps").withColumn("last", F.expr("element_at(starts, -1)")).withColumn(
            "cut",
            F.expr(
                f"""least(last.h, coalesce(get(filter(sequence(IF(leads, 1, 0), size(turns)), j ->
                token_sums[size(turns)] - token_sums[j] <= {history}), 0), size(turns)))"""
            ),
        )
        state = reach.select(
            F.col("conv_id").alias("__conv"),
            F.expr("slice(turns, cut + 1, size(turns) - cut)").alias("tail"),
            F.expr("struct(last.h - cut AS h, last.s - cut AS s)").alias("open"),
            F.expr("leads AND cut = 0").alias("leads"),
        )
    return reduce(DataFrame.unionByName, done)


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of whole turns: ``conv_id, block, window, formatted, loss, repeated, turns, tokens``.

    Turns go in order of (turn, role, text).  A window takes new turns while the system turn,
    the repeated history and they have at most ``budget`` tokens together (letter runs, digits and
    marks of the template, counted by prefix sums); the next window starts with the conversation's
    leading system turn and the latest whole turns of at most ``history`` tokens that leave room
    for its first new turn.  A single turn over the budget gets a window of its own and is never cut.
    Every turn is new in exactly one window.  ``loss`` are the (start, length) spans, in code points of
    ``formatted``, of new assistant texts; repeated turns, headers and marks are outside the mask.
    ``repeated`` counts the turns at the window's beginning that an earlier window has.
    Blocks of 1024 turn numbers are handled one after the other; windows and history reach over their edges,
    and a window's ``block`` is the one in which the next window starts, or the last.

    Null texts and roles are empty ones; a null conv_id is one conversation; null turns come
    first.  Repeated rows are turns of their own.  An empty table gives an empty result; other
    columns are ignored.
    """
    pairs = conversations.select("conv_id", _block().alias("block")).distinct()
    within = Window.partitionBy("conv_id")
    order = pairs.withColumn("step", F.row_number().over(within.orderBy("block"))).withColumn("steps", F.count(F.lit(1)).over(within))
    most = order.agg(F.max("steps")).first()[0] or 1
    blocks = _with_system(_turns(conversations), order)
    single = blocks.where("steps = 1").withColumn("known", F.lit(0)).withColumn("open", F.expr("struct(0 AS h, 0 AS s)"))
    starts = _starts(single, budget, history)
    if most > 1:
        starts = starts.unionByName(_chained(blocks.where("steps > 1"), most, budget, history))
    each = starts.select(
        "conv_id", "block", "turns", "char_sums", "token_sums", "system", "system_tokens", "system_chars", "leads",
        F.posexplode(
            F.expr(
                "transform(IF(step < steps, slice(starts, 1, size(starts) - 1), starts),"
                " (w, k) -> struct(w.h AS h, w.s AS s, coalesce(get(starts, k + 1).s, size(turns)) AS e))"
            )
        ).alias("window", "w"),
    ).withColumn("again", F.expr("system <> '' AND NOT (leads AND w.s = 0)"))
    offset = "IF(again, system_chars, 0L)"
    return each.select(
        "conv_id", "block", "window",
        F.concat(
            F.when(F.col("again"), F.col("system")).otherwise(""),
            F.expr("array_join(transform(slice(turns, w.h + 1, w.e - w.h), t -> t.piece), '')"),
        ).alias("formatted"),
        F.expr(
            f"""transform(filter(sequence(w.s, w.e - 1), i -> turns[i].role = 'assistant'), i -> struct(
                {offset} + char_sums[i] - char_sums[w.h] + turns[i].head_chars AS start,
                cast(turns[i].body_chars AS long) AS length))"""
        ).alias("loss"),
        F.expr("IF(again, 1, 0) + w.s - w.h").alias("repeated"),
        F.expr("w.e - w.s").alias("turns"),
        F.expr("IF(again, system_tokens, 0L) + token_sums[w.e] - token_sums[w.h]").alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window of ``windows()``, parsed from its string and spans alone: ``conv_id, block, window, parsed, loss_text, formatted_chars``.

    ``parsed`` are the new turns as (role, text); ``loss_text`` joins the masked texts.
    """
    split = formatted.withColumn("parts", F.expr(f"slice(split(formatted, '{OPEN.replace('|', '[|]')}'), repeated + 2, turns)"))
    closing = len(CLOSE) + 1
    parsed = F.transform(
        "parts",
        lambda p: F.struct(
            unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(_body(p, closing)).alias("text"),
        ),
    )
    masked = F.array_join(
        F.transform("loss", lambda m: unescaped(F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int")))), ""
    )
    return split.select(
        "conv_id", "block", "window", parsed.alias("parsed"), masked.alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _body(part: Column, closing: int) -> Column:
    role = F.char_length(F.substring_index(part, "\n", 1))
    return F.substring(part, role + 2, F.char_length(part) - role - 1 - closing)


def digests(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Per conversation, from the formatted output: turns, their digest, the loss text's length and digest, and the output's length.

    A digest needs its conversation's text in one row; the windows themselves never do.
    """
    parts = read_back(windows(conversations, budget, history)).select(
        "conv_id",
        F.struct(
            "block", "window",
            F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            "loss_text",
        ).alias("part"),
        F.size("parsed").cast("long").alias("n"),
        "formatted_chars",
    )
    joined = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"), F.sum("formatted_chars").alias("formatted_chars")
    )
    whole = joined.select(
        "conv_id", "n_turns", "formatted_chars",
        F.expr("array_join(transform(parts, p -> p.turns), '')").alias("turns"),
        F.expr("array_join(transform(parts, p -> p.loss_text), '')").alias("loss_text"),
    )
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.col("turns"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
