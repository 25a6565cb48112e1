"""Removal of lines that repeat an earlier line, long ones up to one word, found through deletion neighbourhoods."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from metricwatch.llm.common import identified, shielded, small_batches, text_key, utf8
from metricwatch.llm.line_quality import BLANKS
from metricwatch.llm.suffixes import packed, unpacked
from metricwatch.sources import discard, written

# Bytes of numbers and lines that a task holds before it sends them on, and of text that it looks at at once.
SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))


def half(n: np.ndarray | int) -> np.ndarray:
    """About half of ``n`` words, never more: from 32 words on only every 2nd, from 64 on every 4th ... number, so most neighbours agree."""
    k = np.asarray(n, np.int64) // 2
    step = 1 << np.maximum(np.frexp(k)[1].astype(np.int64) - 4, 0)
    return k // step * step


@lru_cache(1 << 12)
def parts(n: int) -> list[int]:
    """How many words from either end of a line of ``n`` words are hashed: as lines of ``n`` and of ``n - 1`` words do."""
    return sorted({int(half(n)), int(half(n - 1))}, reverse=True)


def half_keys(plain: bytes, ends: list[int], starts: list[int]) -> Iterator[int]:
    """Keys of the line's first words, up to each of ``ends``, and of its last ones, from ``starts``.

    One edit leaves the ``parts`` before it or those behind it as they are, so lines within one word
    of each other share a key.
    """
    for end, start in zip(ends, starts):
        yield xxh3_64_intdigest(plain[:end], 1)
        yield xxh3_64_intdigest(plain[start:], 2)


def _mixed(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for every word at its place (the final steps of SplitMix64)."""
    x = words + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_hashes(words: list[bytes], shared: int) -> tuple[np.ndarray, np.ndarray]:
    """``(gaps, hashes)``: hash of the line (gap 0), then of the line without its first (gap 1), second ... word.

    A hash is the sum of a number for every word and its place, so all take time in proportion to
    the line.  ``shared`` has a bit for each of the line's half keys that another line has too: an
    edit lies behind first words or before last words that two lines share.
    """
    n = len(words)
    own, place = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n), np.arange(n)
    sums = np.zeros((2, n + 1), np.uint64)
    np.cumsum(_mixed(own, place), out=sums[0, 1:])
    np.cumsum(_mixed(own, place - 1), out=sums[1, 1:])  # the words behind a gap move up by one
    ks = parts(n)
    low = min((k for i, k in enumerate(ks) if shared >> 2 * i & 1), default=n)
    high = max((n - k for i, k in enumerate(ks) if shared >> 2 * i & 2), default=0)
    at = np.concatenate([place[:high], place[max(low, high) :]])
    hashes = np.append(sums[0, n], sums[0, at] + sums[1, n] - sums[1, at + 1])
    return np.append(0, at + 1), hashes.view(np.int64)


class _Slice:
    """Rows about to be sent on, as flat numbers: no object per number."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.select(["doc_id", "text_key"])
        self.rows, self.line = array("q"), array("q")
        self.flat, self.ends = array("Q"), array("i", [0])  # the rows' lists of numbers
        self.columns: dict[str, list | array] = {}

    def size(self) -> int:
        return 8 * (len(self.rows) + len(self.flat))

    def arrays(self, list_name: str) -> dict[str, pa.Array]:
        rows = pa.array(np.frombuffer(self.rows, np.int64))
        lists = pa.ListArray.from_arrays(np.frombuffer(self.ends, np.int32), np.frombuffer(self.flat, np.int64))
        own = {"doc_id": self.ids.column(0).take(rows), "text_key": self.ids.column(1).take(rows)}
        return own | {"line": pa.array(np.frombuffer(self.line, np.int64)), list_name: lists}


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Lines one below the other, about ``PIECE_BYTES`` at a time: ``(row, line, lines)`` with each line's text and number in it."""
    rows, numbers, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        start = line = 0
        while start <= len(text):
            # Only texts that are longer than a piece are parted, at the end of a line.
            stop = text.find(b"\n", start + PIECE_BYTES) if len(text) - start > PIECE_BYTES else -1
            held.append(text[start : stop if stop >= 0 else len(text)])
            n = held[-1].count(b"\n") + 1
            rows += [row] * n
            numbers += range(line, line + n)
            size, line, start = size + len(held[-1]), line + n, stop + 1 if stop >= 0 else len(text) + 1
            if size > PIECE_BYTES:
                yield rows, numbers, b"\n".join(held)
                rows, numbers, held, size = [], [], [], 0
    if rows:
        yield rows, numbers, b"\n".join(held)


def hashed_lines(piece: bytes, min_words: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """``(number, hash, half keys)`` of every line with a word, its words parted by one blank; keys from ``min_words`` words on."""
    piece = b"\n%s\n" % piece
    data = np.frombuffer(piece, np.uint8)
    blank = IS_BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]  # of words
    if not len(starts):
        return
    first = np.searchsorted(starts, np.flatnonzero(data == 10))
    number = np.flatnonzero(np.diff(first))
    first, n = first[number], np.diff(first)[number]
    last = first + n - 1
    # Lines whose words are not parted by one blank each.
    wide = np.append(0, np.cumsum((starts[1:] - ends[:-1] != 1) | (data[ends[:-1]] != 32)))
    wide = wide[last] != wide[first]
    begin, end = starts[first], ends[last]
    cuts = []
    for k in (half(n), half(n - 1)):
        cuts += [np.where(k > 0, ends[np.maximum(first + k - 1, 0)], begin) - begin, np.where(k > 0, starts[np.minimum(last + 1 - k, last)], end) - begin]
    cuts = np.stack(cuts, 1).tolist()
    for i, a, b, size, odd, (e1, s1, e2, s2) in zip(number.tolist(), begin.tolist(), end.tolist(), n.tolist(), wide.tolist(), cuts):
        plain = piece[a:b]
        at, behind = ([e1, e2], [s1, s2]) if e1 != e2 else ([e1], [s1])
        if odd:
            words = plain.split()
            plain = b" ".join(words)
            at = [len(b" ".join(words[:k])) for k in parts(size)]
            behind = [len(plain) - len(b" ".join(words[size - k :])) for k in parts(size)]
        yield i, xxh3_128_digest(plain), [*half_keys(plain, at, behind)] if size >= min_words else []


def lines(texts: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, text_key, line, keys, h, g)``: 128 bits of hash of every line with a word; half keys from ``min_words`` words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = _Slice(batch), []

            def sent(out: _Slice, digests: list[bytes]) -> pa.RecordBatch:
                h, g = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).T.astype(np.int64)
                return pa.RecordBatch.from_pydict(out.arrays("keys") | {"h": pa.array(h), "g": pa.array(g)})

            for rows, numbers, piece in pieces(utf8(batch.column(2))):
                for i, digest, keys in hashed_lines(piece, min_words):
                    out.rows.append(rows[i])
                    out.line.append(numbers[i])
                    digests.append(digest)
                    out.flat.extend(keys)
                    out.ends.append(len(out.flat))
                if out.size() > SLICE_BYTES:
                    yield sent(out, digests)
                    out, digests = _Slice(batch), []
            if out.rows:
                yield sent(out, digests)

    return texts.mapInArrow(run, "doc_id long, text_key long, line long, keys array<long>, h long, g long")


def _before(a: str, b: str) -> Column:
    """Order of places (doc_id, line); a null doc_id comes first."""
    return F.expr(
        f"{a}.doc_id IS NULL AND {b}.doc_id IS NOT NULL OR {a}.doc_id < {b}.doc_id"
        f" OR {a}.doc_id <=> {b}.doc_id AND {a}.line < {b}.line"
    )


def within_one_word(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lists of words differ by at most one replaced, added or dropped word."""
    short, long = sorted((a, b), key=len)
    first = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return long[first + 1 :] == short[first + (len(short) == len(long)) :] and len(long) - len(short) < 2


def near_links(candidates: DataFrame) -> DataFrame:
    """``(place, earlier)``: lines and an earlier line that differs by one word, from the lines' deletion neighbourhoods.

    ``candidates`` have ``place``, ``gaps``, ``variants`` and ``text``.  Lines of equal length differ in
    one word if they agree without the word at the same position; lines of unequal length if
    one is the other without some word.  Each group of equal variants is reduced to its
    earliest line, and only that one is compared, so a group of any size costs one row a member.
    """
    variants = candidates.select("place", F.inline(F.arrays_zip(F.col("gaps").alias("gap"), F.col("variants").alias("k"))))
    # Nearly all variants are of one line only: these are moved no further.
    several = variants.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    variants = written(variants.join(several, "k"), "lines-variants")
    same = variants.where("gap > 0").groupBy("k", "gap").agg(F.min("place").alias("earlier"), F.count(F.lit(1)).alias("n")).where("n > 1")
    replaced = variants.join(same, ["k", "gap"]).select("place", "earlier")
    mixed = (
        variants.groupBy("k")
        .agg(F.min(F.when(F.col("gap") == 0, F.col("place"))).alias("whole"), F.min(F.when(F.col("gap") > 0, F.col("place"))).alias("longer"))
        .where("whole IS NOT NULL AND longer IS NOT NULL")
    )
    dropped = variants.join(mixed, "k").select("place", F.when(F.col("gap") == 0, F.col("longer")).otherwise(F.col("whole")).alias("earlier"))
    pairs = written(replaced.unionByName(dropped).where(_before("earlier", "place")).distinct(), "lines-pairs")
    discard(variants)
    # One earlier line is enough, so the others are looked at only where hashes misled.
    with small_batches(candidates.sparkSession):
        near = written(verified(pairs.groupBy("place").agg(F.min("earlier").alias("earlier")), candidates), "lines-near")
        rest = written(pairs.join(near.select("place"), "place", "left_anti"), "lines-unlike")
        if not rest.isEmpty():
            near = near.unionByName(written(verified(rest, candidates), "lines-near"))
    discard(pairs, rest)
    return near


def verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ``pairs`` whose words are within one word of each other; only lines of pairs are parted into words again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(utf8(batch.column("own")), utf8(batch.column("other")))
            alike = pa.array([within_one_word(own.split(), other.split()) for own, other in texts], pa.bool_())
            yield batch.select(["place", "earlier"]).filter(alike)

    texts = candidates.select("place", "text")
    both = pairs.join(texts.withColumnsRenamed({"text": "own"}), "place").join(
        texts.select(F.col("place").alias("earlier"), F.col("text").alias("other")), "earlier"
    )
    place = "struct<doc_id: long, line: long, text_key: long>"
    return both.select("place", "earlier", "own", "other").mapInArrow(run, f"place {place}, earlier {place}")


def repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``(doc_id, text_key, line)`` of the lines to remove: all that an earlier line equals up to one word.

    1. Lines with a word are reduced to hashes of their words; equal ones keep the earliest place.
    2. Lines of ``min_words`` or more that share one of the halves that an edit leaves alone are candidates.  The
       deletion neighbourhood, one variant a word outside the shared half, is made for those only: a line
       without such a partner has no partner at all.
    3. Equal variants are joined, the distance is verified on the words, the earliest stays.
    """
    texts = identified(docs)
    with small_batches(docs.sparkSession):
        all_lines = written(lines(texts, min_words), "lines-hashed")
    first = F.min(F.struct("doc_id", "line", "text_key")).alias("first")
    distinct = written(all_lines.groupBy("h", "g").agg(first, F.count(F.lit(1)).alias("n")), "lines-distinct")
    copies = written(
        all_lines.drop("keys").join(distinct.where("n > 1").select("h", "g", "first"), ["h", "g"]).alias("own")
        .where("NOT (own.doc_id <=> first.doc_id AND own.line = first.line)")
        .select("doc_id", "text_key", "line"),
        "lines-copies",
    )
    keys = all_lines.select("h", F.posexplode("keys").alias("at", "key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    partners = keys.join(shared, "key").groupBy("h").agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("shared"))
    places = distinct.join(partners, "h").select("first.*", "shared")
    wanted = written(places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("line", "shared")).alias("wanted")), "lines-wanted")
    discard(all_lines, distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kept, gaps, size = _Slice(batch), [], [], 0

            def sent(out: _Slice, kept: list[bytes], gaps: list[np.ndarray]) -> pa.RecordBatch:
                own = out.arrays("variants")
                at = pa.ListArray.from_arrays(own["variants"].offsets, np.concatenate(gaps).astype(np.int32))
                return pa.RecordBatch.from_pydict(own | {"gaps": at, "text": pa.array(kept, pa.binary()).cast(pa.string())})

            for row, own in enumerate(batch.column("wanted").to_pylist()):
                split = unpacked(batch.column("packed").slice(row, 1))[0].split(b"\n")
                for i, shared in map(dict.values, own):
                    at, hashes = deletion_hashes(split[i].split(), shared)
                    gaps.append(at)
                    out.rows.append(row)
                    out.line.append(i)
                    out.flat.frombytes(hashes.tobytes())
                    out.ends.append(len(out.flat))
                    kept.append(split[i])
                    size += len(split[i])
                if out.size() + size > SLICE_BYTES:
                    yield sent(out, kept, gaps)
                    out, kept, gaps, size = _Slice(batch), [], [], 0
            if kept:
                yield sent(out, kept, gaps)

    # The null-safe key as columns, so that what parts texts among tasks to drop repeated rows also serves the join.
    key = {"__doc": F.coalesce("doc_id", F.lit(0)), "__null": F.col("doc_id").isNull(), "__key": F.col("text_key")}
    other = wanted.withColumns(key).select(*key, "wanted")
    joined = packed(texts).withColumns(key).dropDuplicates([*key]).join(other, [*key]).drop(*key)
    found = joined.mapInArrow(run, "doc_id long, text_key long, line long, variants array<long>, gaps array<int>, text string")
    with small_batches(docs.sparkSession):
        candidates = written(found.select(F.struct("doc_id", "line", "text_key").alias("place"), "gaps", "variants", "text"), "lines-candidates")
    near = near_links(candidates).select("place.doc_id", "place.text_key", "place.line")
    gone = written(copies.unionByName(near).distinct(), "lines-gone")
    discard(copies, wanted, candidates)
    return gone


@shielded
def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line up to one replaced, added or dropped word.

    Lines are cut at \\n and compared by their words (between ASCII white space).  Earlier means
    a smaller doc_id, or further ahead in the same text; the earlier line need not stay itself, so a
    chain of small edits leaves its first line.  Lines of fewer than ``min_words`` words (one
    word of five is a fifth) go only as exact repeats; lines without words stay.

    Rows and columns stay; ``text`` is rewritten and ``n_chars``, if there is one, counted anew where lines went.
    A text that loses all its lines is empty.  Null and empty texts stay as they are.  A null
    doc_id comes before all others.  Rows that share a doc_id stand at the same place, so
    repeated rows give equal results.  An empty table gives an empty result.
    """
    gone = repeated_lines(docs, min_words).groupBy("doc_id", "text_key").agg(F.collect_list("line").alias("__gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    keyed = docs.withColumn("__own", text_key())
    # Texts are not sorted: the lines that go, one row a text, are looked up.
    joined = keyed.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    rewritten = joined.withColumn("__lines", F.split("text", "\n", -1)).withColumn(
        "__text",
        F.when(
            F.col("__gone").isNotNull(),
            F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0).cast("long"), (F.size("__lines") - 1).cast("long")), "__gone"),
                    lambda i: F.element_at("__lines", i.cast("int") + 1),
                ),
                "\n",
            ),
        ).otherwise(F.col("text")),
    )
    n_chars = F.when(F.col("__gone").isNotNull(), F.char_length("__text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("__text"), "n_chars": n_chars}
    return rewritten.select(
        *[
            new[f.name].cast(f.dataType).alias(f.name) if f.name in new and isinstance(f.dataType, (T.StringType, T.IntegralType)) else F.col(f"`{f.name}`")
            for f in docs.schema.fields
        ]
    )
