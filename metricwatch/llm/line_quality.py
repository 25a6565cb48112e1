"""Quality rules from word counts and from how many documents of a host share a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import SPACE, shielded, text_key

# White space, symbols and base limits of the rules.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_SHARE = 50, 0.5


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def word_array(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    inner = _trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case, with digits as 0 and white space runs as one blank."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_trimmed(line)), SPACE, " "), "[0-9]", "0")
    return F.xxhash64(plain)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: _trimmed(line) != "")


def base_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` per row."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        word_array(text).alias("words"),
        lines_with_words(text).alias("lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    # Windows of three words as (hash, position); equal ones become neighbours by sorting.
    runs = words.select(
        "doc_id", "text_key", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)),"
            " (w, i) -> struct(xxhash64(w, get(words, i + 1), get(words, i + 2)) AS h, i AS i)))"
        ).alias("runs"),
    )
    repeated = runs.withColumn(
        "at",
        F.expr(
            "sort_array(transform(filter(runs, (r, k) -> r.h = get(runs, k - 1).h OR r.h = get(runs, k + 1).h),"
            " r -> r.i))"
        ),
    )
    covered = F.expr(
        "aggregate(at, struct(0L AS n, 0 AS past),"
        " (a, p) -> struct(a.n + p + 3 - greatest(a.past, p) AS n, p + 3 AS past), a -> a.n)"
    )
    return repeated.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words")
    )


def host_sizes(docs: DataFrame, host: str) -> DataFrame:
    """``(host, host_docs)``: distinct documents of each host, counted in two steps that combine before they shuffle."""
    named = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col("doc_id").cast("long").alias("doc_id"))
    return named.groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))


def shared_lines(docs: DataFrame, host: str, max_docs: int, max_percent: int) -> DataFrame:
    """``(doc_id, text_key, host, h, chars)``: per row its distinct lines, with ``frequent`` set on those to remove.

    A line is frequent if more than ``max_docs`` documents of its host have it and these are more than
    ``max_percent`` percent of the host's documents, so the limit grows with the host.  The host's first
    document with the line keeps it, so no text is lost to the corpus.  Documents are counted
    after rows are reduced to (host, line, document), and both counts combine before they shuffle; only lines
    over ``max_docs`` meet their host's size.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        F.coalesce(F.col(host), F.lit("")).alias("host"),
        F.explode(
            F.transform(lines_with_words(text), lambda x: F.struct(line_hash(x).alias("h"), F.length(x).cast("long").alias("n")))
        ).alias("line"),
    )
    own = lines.groupBy("host", F.col("line.h").alias("h"), "doc_id", "text_key").agg(F.sum("line.n").alias("chars"))
    spread = (
        own.groupBy("host", "h", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("host", "h")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keeper"))
        .where(F.col("n_docs") > max_docs)
        .join(host_sizes(docs, host), "host")
        .where(F.col("n_docs") * 100 > F.col("host_docs") * max_percent)
        .drop("host_docs")
    )
    return own.join(spread, ["host", "h"], "left").select(
        "doc_id", "text_key", "host", "h", "chars",
        (F.col("n_docs").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper"))).alias("frequent"),
    )


def line_verdicts(docs: DataFrame, host: str = "source", max_docs: int = 10, max_percent: int = 1, min_left: float = 0.3) -> DataFrame:
    """``(doc_id, text_key, host, removed_chars, line_chars, depleted)`` of rows that have a line with a word.

    A row is depleted if less than ``min_left`` of its lines' characters stays.
    """
    sums = shared_lines(docs, host, max_docs, max_percent).groupBy("doc_id", "text_key", "host").agg(
        F.sum(F.when(F.col("frequent"), F.col("chars")).otherwise(0)).alias("removed_chars"),
        F.sum("chars").alias("line_chars"),
    )
    left = F.col("line_chars") - F.col("removed_chars")
    return sums.withColumn("depleted", left < F.lit(min_left) * F.col("line_chars"))


def assess(docs: DataFrame, host: str = "source", max_docs: int = 10, max_percent: int = 1, min_left: float = 0.3) -> DataFrame:
    """Counts and verdict per row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A row fails the base rules with fewer than 50 words or when windows of three words that
    occur twice cover more than half of its words.  Otherwise it is kept unless the removal of
    lines that more than ``max_docs`` documents and ``max_percent`` percent of its host share leaves it depleted.

    Null and empty texts have no words and fail the base rules.  A null host counts as the host
    ''.  Null doc_ids count as one document.  Repeated rows stay and give equal results; rows
    that share id, text and host count once.  An empty table gives an empty result; other columns are ignored.
    """
    base = base_counts(docs.withColumn("doc_id", F.col("doc_id")))
    thin = line_verdicts(docs, host, max_docs, max_percent, min_left).groupBy("doc_id", "text_key").agg(F.max("depleted").alias("depleted"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * F.lit(REPEAT_SHARE) * F.col("n_words"))
    b, t = base.alias("b"), thin.alias("t")
    joined = b.join(
        t, F.col("b.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("b.text_key") == F.col("t.text_key")), "left"
    )
    return joined.select(
        "b.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
    )


@shielded
def clean(docs: DataFrame, host: str = "source", max_docs: int = 10, max_percent: int = 1, min_left: float = 0.3) -> DataFrame:
    """``docs`` without the frequent lines, and without the rows that this leaves depleted.

    Columns stay; only ``text`` changes.  Rows without any line to remove keep their text as it is.
    """
    lines = shared_lines(docs, host, max_docs, max_percent)
    per_row = lines.groupBy("doc_id", "text_key", "host").agg(
        F.collect_set(F.when(F.col("frequent"), F.col("h"))).alias("__gone"),
        F.sum(F.when(F.col("frequent"), 0).otherwise(F.col("chars"))).alias("__left"),
        F.sum("chars").alias("__all"),
    ).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("host").alias("__host"), "__gone", "__left", "__all")
    keyed = docs.withColumn("__own", text_key())
    joined = keyed.join(
        per_row,
        keyed["doc_id"].eqNullSafe(per_row["__id"]) & (keyed["__own"] == per_row["__key"])
        & (F.coalesce(keyed[host], F.lit("")) == per_row["__host"]),
        "left",
    ).where(F.coalesce(F.col("__left") >= F.lit(min_left) * F.col("__all"), F.lit(True)))
    kept = F.array_join(
        F.filter(F.split("text", "\n", -1), lambda x: (_trimmed(x) == "") | ~F.array_contains("__gone", line_hash(x))), "\n"
    )
    text = F.when(F.size("__gone") > 0, kept).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
