"""How far the sources of a language differ in their words, from bitmaps of terms per source and count.

Absolute differences of smoothed shares are summed over a language's vocabulary for every pair
of sources.  The terms of a source with the same count form one level, whose terms have one
share; a level is stored as bitmaps of term ids.  The AND of two levels' bitmaps, counted, is
the number of terms with just these two counts, which is multiplied by the difference of the
two shares.  Terms that one or both sources lack follow by complement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.llm.common import utf8
from metricwatch.operators.ranking import running_totals
from metricwatch.sources import discard, written

# Fixed values of the smoothed share: scale and pseudo-count.
SCALE, EXTRA = 1_000_000_000, 5
# Terms are runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased.  In UTF-8 this
# is a rule on bytes: letters and bytes from 0x80 on stay, all others part terms.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FLUSH_TERMS, FLUSH_BYTES = 200_000, 1 << 25  # counts that a task holds before it sends them on
WORDS_A_BLOCK = 64  # 64-bit words of term ids in one group of the pair step
CELLS = 1 << 20  # pairs of levels compared at a time


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed over as many rows as fit."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    n_terms = n_bytes = 0

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(list(n), pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for group, text in zip(groups, utf8(batch.column(2))):
            found = terms(text)
            n, docs = held.setdefault(group, (Counter(), Counter()))
            before = len(n)
            n.update(found)
            docs.update(set(found))
            n_terms += len(n) - before
            n_bytes += len(text)
            if n_terms > FLUSH_TERMS or n_bytes > FLUSH_BYTES:
                yield from sums()
                n_terms = n_bytes = 0
    yield from sums()


def term_counts(groups: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``groups(lang, source, text)``."""
    partial = groups.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, vocabulary: str) -> Column:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * vocabulary)) in exact decimals; 0 without a vocabulary."""
    return F.expr(
        f"CASE WHEN {vocabulary} > 0 THEN 1 + cast({SCALE} AS decimal(10, 0)) * cast({count} + {EXTRA} AS decimal(19, 0))"
        f" div cast({total} + {EXTRA} * {vocabulary} AS decimal(20, 0)) ELSE 0L END"
    )


def _marginal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Distances of source pairs as if no term occurred in both: level sizes times the difference to share 0.

    ``rows`` are levels ``(source, tile, p, cells, p0, size, v)`` of two tiles; the level of
    absent terms has ``cells`` 0 and is in every part.  The terms that neither has are counted in part 0.
    """
    lang, low, high, part = key
    rows = rows.sort_values(["source", "p"], kind="stable")
    names = rows["source"].to_numpy(object)
    first = np.nonzero(np.append(True, names[1:] != names[:-1]))[0]
    names = names[first]
    tile, p0, size = (rows[c].to_numpy()[first] for c in ("tile", "p0", "size"))
    v = int(rows["v"].iloc[0])
    levels, cells = rows["p"].to_numpy(np.int64), rows["cells"].to_numpy(np.int64)
    ends = np.append(first[1:], len(rows))
    toward = np.empty((len(names), len(names)), np.int64)  # [a, b]: a's levels against b's share of absent terms
    for a, (lo, hi) in enumerate(zip(first, ends)):
        level, count = levels[lo:hi], cells[lo:hi]
        upto, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * level))
        below = np.searchsorted(level, p0)
        toward[a] = p0 * upto[below] - mass[below] + (mass[-1] - mass[below]) - p0 * (upto[-1] - upto[below])
    total = toward + toward.T
    if part == 0:
        total += (v - size[:, None] - size[None, :]) * np.abs(p0[:, None] - p0[None, :])
    if low == high:
        a, b = np.triu_indices(len(names), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.nonzero(tile == low)[0], np.nonzero(tile == high)[0], indexing="ij"))
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": total[a, b]})


def _joint(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What terms in both sources change in the sums of :func:`_marginal`, from the levels' bitmaps.

    ``rows`` are bitmaps ``(source, tile, word, bits, p, p0)`` of one block of term ids and two tiles.
    """
    lang, _, low, high = key
    codes, names = pd.factorize(rows["source"], sort=False)
    order = np.lexsort((codes, rows["word"].to_numpy()))
    codes, tile, word = codes[order], rows["tile"].to_numpy()[order], rows["word"].to_numpy()[order]
    bits = rows["bits"].to_numpy(np.int64)[order].view(np.uint64)
    p, p0 = rows["p"].to_numpy(np.int64)[order], rows["p0"].to_numpy(np.int64)[order]
    total = np.zeros((len(names), len(names)), np.int64)
    bounds = np.nonzero(np.diff(word, prepend=-1, append=-1))[0]
    for start, stop in zip(bounds, bounds[1:]):
        at = np.arange(start, stop)
        left, right = at[tile[at] == low], at[tile[at] == high]
        if not len(left) or not len(right):
            continue
        right_starts = np.nonzero(np.diff(codes[right], prepend=-1))[0]
        for cut in range(0, len(left), max(1, CELLS // len(right))):
            l = left[cut : cut + max(1, CELLS // len(right)), None]  # noqa: E741
            cells = np.bitwise_count(bits[l] & bits[right]).astype(np.int64)
            f = np.abs(p[l] - p[right]) - np.abs(p[l] - p0[right]) - np.abs(p0[l] - p[right]) + np.abs(p0[l] - p0[right])
            left_starts = np.nonzero(np.diff(codes[l[:, 0]], prepend=-1))[0]
            sums = np.add.reduceat(np.add.reduceat(cells * f, left_starts, axis=0), right_starts, axis=1)
            total[np.ix_(codes[l[left_starts, 0]], codes[right[right_starts]])] += sums
    if low == high:
        a, b = np.triu_indices(len(names), 1)  # the other half is the same
    else:
        a, b = np.nonzero(total)
    names = np.asarray(names, object)
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": total[a, b]})


_PAIR = "lang string, a string, b string, value long"


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, tile: int = 64, levels_a_part: int = 500_000) -> DataFrame:
    """Distances between sources and the terms that set a source apart: ``(lang, source, part, item, value, rank)``.

    A language's vocabulary are the V terms in at least ``min_docs`` of its rows.  A source with
    N occurrences of these gives a term that it has c times the share
    1 + floor(10^9 (c + 5) / (N + 5 V)); so does the language as a whole.  Part ``pair`` has
    every other source of the language with the summed absolute differences of shares (0 if V is
    0), part ``term`` up to ``top`` terms that the source has and whose share there exceeds the
    language's, with the excess.  Ranks go by descending value, then by the item's UTF-8 bytes.

    Null text, lang and source count as ''.  Every row is a document, repeated rows and rows with
    null or equal doc_ids too.  Sources without terms take part with N = 0.  A language with one
    source has no pairs.  An empty table gives an empty result; other columns are ignored.

    Rows are counted where they are read, so a hot source or word costs one row a task.  Sources
    are put into tiles of about ``tile``; a group of the pair step holds two tiles and a block of term
    ids, or two tiles and a part of the levels, and is bounded whatever the number of sources or terms.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    rows = docs.select(*text.values())
    counts = written(term_counts(rows), "divergence-counts")
    vocabulary = (
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
        .where(F.col("docs") >= min_docs)
        .select("lang", F.struct((-F.col("total")).alias("less"), "term").alias("place"), F.lit(1).alias("one"))
    )
    # Frequent terms first: the levels of a block are few where counts are small.
    placed = running_totals(vocabulary, ["lang"], "place", ["one"]).select(
        "lang", F.col("place.term").alias("term"), (-F.col("place.less")).alias("total"), F.col("one_before").cast("long").alias("id")
    )
    kept = written(counts.join(placed, ["lang", "term"]).drop("docs"), "divergence-kept")
    discard(counts)
    langs = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sized = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("size"))
    zero = F.lit(0).cast("long")
    groups = (
        rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sized, ["lang", "source"], "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "lang_n", "group_n", "size")])
    )
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    info = written(
        groups.join(tiles, "lang")
        .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
        .withColumn("p0", share("0L", "group_n", "v")),
        "divergence-sources",
    )
    shared = kept.join(info, ["lang", "source"]).withColumn("p", share("n", "group_n", "v"))

    bitmaps = shared.groupBy("lang", "source", "tile", "tiles", "p0", "p", F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 AS int))")).alias("bits")
    )
    # Every tile meets every other once, the smaller number first.
    meet = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    low, high = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    block = F.floor(F.col("word") / WORDS_A_BLOCK).alias("block")
    joint = (
        bitmaps.select("*", meet).select("lang", "source", "tile", "word", "bits", "p", "p0", block, low, high)
        .groupBy("lang", "block", "low", "high").applyInPandas(_joint, _PAIR)
    )
    levels = shared.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("cells"))
    parts = levels.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / levels_a_part).cast("int").alias("parts"))
    split = info.join(parts, "lang", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    marked = levels.join(split, ["lang", "source"]).select(
        "lang", "source", "tile", "tiles", "p", "cells", "p0", "size", "v", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int").alias("part")
    )
    absent = split.select(
        "lang", "source", "tile", "tiles", F.col("p0").alias("p"), zero.alias("cells"), "p0", "size", "v",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    marginal = (
        marked.unionByName(absent).select("*", meet).select("lang", "source", "tile", "p", "cells", "p0", "size", "v", "part", low, high)
        .groupBy("lang", "low", "high", "part").applyInPandas(_marginal, _PAIR)
    )
    ordered = joint.unionByName(marginal).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    distances = written(ordered.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    both = distances.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        distances.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    excess = shared.select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - share("total", "lang_n", "v")).alias("value")
    ).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = both.select("*", F.lit("pair").alias("part"), rank).select(columns)
    above = excess.select("*", F.lit("term").alias("part"), rank).where(F.col("rank") <= top).select(columns)
    return pairs.unionByName(above)
