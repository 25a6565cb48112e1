"""Removal of repeated byte windows by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import identified, map_batches, utf8
from metricwatch.sources import discard, written

DIGIT = 32  # bytes of the first digit
FLANK = 7  # windows are told apart eight at a time
POSITION_BITS = 24
PIECE = 1 << 20  # bytes hashed at a time; longer texts go in overlapping pieces
_TABLES = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
_ODD = np.random.default_rng(20240301).integers(1, 1 << 63, size=(2, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    return x


def run_hashes(data: np.ndarray, longest: int, family: int = 0) -> dict[int, np.ndarray]:
    """Hashes of the runs of 1, 2, 4 ... ``longest`` bytes at every position, each from two halves."""
    hashes = {1: _TABLES[family][data]}
    size, step = 1, 0
    while size < longest:
        half = hashes[size]
        if len(half) <= size:
            hashes[2 * size] = half[:0]
        else:
            hashes[2 * size] = _stir(half[:-size] * _ODD[family][2 * step] + half[size:] * _ODD[family][2 * step + 1])
        size, step = 2 * size, step + 1
    return hashes


def window_hashes(hashes: dict[int, np.ndarray], at: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Hashes of the ``length`` bytes from each position, put together from runs of powers of two."""
    out, done = np.full(len(at), length, dtype=np.uint64), 0
    for size in sorted(hashes, reverse=True):
        while length - done >= size:
            out = _stir((out + hashes[size][at + done]) * _ODD[family][15])
            done += size
    return out


def _pieces(texts: list[bytes], length: int):
    """Texts joined to buffers of about ``PIECE`` bytes: ``(data, row, offset in text, place in data, bytes)`` lists."""
    data, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            data.append(piece)
            parts.append((row, at, size, len(piece)))
            size += len(piece)
            if size >= PIECE // 8:
                yield np.frombuffer(b"".join(data), np.uint8), parts
                data, parts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(data), np.uint8), parts


def _anchors(data: np.ndarray, parts: list, length: int):
    """First digits of a buffer's windows: ``(row, text position, digit hash, context hash, lead, tail)`` arrays.

    A window's first digit is the ``DIGIT``-byte run in it with the smallest hash, the earliest
    on ties.  Neighbouring windows share it, so a row stands for the windows that start ``lead``
    to ``tail`` bytes before it.
    """
    hashes = run_hashes(data, 64)
    digit = hashes[DIGIT]
    mask = np.uint64((1 << POSITION_BITS) - 1)
    low = ((digit * _ODD[0][14]) & ~mask) | np.arange(len(digit), dtype=np.uint64)
    reach, width = length - DIGIT + 1, 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    valid = np.ones(len(low), dtype=bool)
    for _, _, place, size in parts[:-1]:
        valid[place + size - length + 1 : place + size] = False
    starts = np.flatnonzero(valid)
    anchor = (low[starts] & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    at, lead, tail = anchor[first], anchor[first] - starts[first], anchor[first] - starts[last]
    context = window_hashes(hashes, starts[first], length)
    context = _stir((context * _ODD[0][13] + window_hashes(hashes, starts[last], length)) * _ODD[0][12])
    context = _stir((context + (lead * 256 + tail).astype(np.uint64)) * _ODD[0][11])
    place = np.array([p[2] for p in parts])
    part = np.searchsorted(place, at, side="right") - 1
    rows = np.array([p[0] for p in parts])[part]
    inside = at - place[part] + np.array([p[1] for p in parts])[part]
    return rows, inside, digit[at], context, lead, tail


def first_digits(docs: DataFrame, length: int, full: bool) -> DataFrame:
    """Rows of ``identified`` texts' first digits; without ``full`` only the digit hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [_anchors(data, parts, length) for data, parts in _pieces(utf8(batch.column(2)), length)]
        if not found:
            return None
        rows, inside, digit, context, lead, tail = (np.concatenate(x) for x in zip(*found))
        columns = [pa.array(digit.view(np.int64))]
        if not full:
            return pa.RecordBatch.from_arrays(columns, ["h"])
        rows = pa.array(rows)
        columns += [
            pa.array(context.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
            pa.array(inside << 16 | lead << 8 | tail),
        ]
        return pa.RecordBatch.from_arrays(columns, ["h", "c", "doc_id", "text_key", "place"])

    return map_batches(docs, run, "h long, c long, doc_id long, text_key long, place long" if full else "h long")


def _later(order: str = "start") -> str:
    """Whether a row comes after the first one of its group; a null doc_id comes before all others."""
    return (
        "NOT (doc_id <=> first.doc_id) AND first.doc_id IS NULL OR doc_id > first.doc_id"
        f" OR doc_id <=> first.doc_id AND {order} > first.{order}"
    )


def settle(rows: DataFrame, key: list[str], same: list[str], label: str, *also: str) -> tuple[DataFrame, DataFrame]:
    """One pass of the sort.  ``rows``, a written table, have ``doc_id, text_key, start, stop`` and are deleted.

    Returns the ranges of rows that are equal in ``key`` and ``same`` to an earlier row, and the
    earliest row of each ``same`` where a ``key`` has several: the ones that further digits have
    to tell apart.  A key of one row is in neither.
    """
    first = F.min(F.struct("doc_id", "start", "stop", "text_key", *also)).alias("first")
    classes = written(rows.groupBy(*key, *same).agg(first, F.count(F.lit(1)).alias("n")), f"{label}-classes")
    repeated = classes.where("n > 1").select(*key, *same, "first")
    whole = rows.join(repeated, [*key, *same]).where(_later()).select("doc_id", "text_key", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    whole = written(whole, f"{label}-whole")
    discard(rows)
    several = classes.groupBy(*key).count().where("count > 1").drop("count")
    split = written(classes.join(several, key).select(*key, *same, "first.*"), f"{label}-split")
    discard(classes)
    return whole, split


def _segments(texts: list[bytes], columns: list[list]):
    """Buffers of the texts' parts that lie in ranges: ``(data, rows, shift, start, stop, anchor)``.

    Adding ``shift`` to a text position gives the place in ``data``.
    """
    data, parts, size = [], [], 0
    for row, (text, *own) in enumerate(zip(texts, *columns)):
        start, stop, anchor = (np.array(c, dtype=np.int64) for c in own)
        order = np.argsort(start, kind="stable")
        start, stop, anchor = start[order], stop[order], anchor[order]
        far = start[1:] > np.maximum.accumulate(stop)[:-1]
        cuts = np.flatnonzero(far | (start[1:] // PIECE != start[:-1] // PIECE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)]):
            piece = text[start[a] : stop[a:b].max()]
            data.append(piece)
            parts.append((np.full(b - a, row), np.full(b - a, size - start[a]), start[a:b], stop[a:b], anchor[a:b]))
            size += len(piece)
            if size >= PIECE // 8:
                yield (np.frombuffer(b"".join(data), np.uint8), *(np.concatenate(p) for p in zip(*parts)))
                data, parts, size = [], [], 0
    if parts:
        yield (np.frombuffer(b"".join(data), np.uint8), *(np.concatenate(p) for p in zip(*parts)))


def _bytes_as_long(data: np.ndarray, at: np.ndarray, step: int, count: np.ndarray) -> np.ndarray:
    """Up to 7 bytes from ``at`` in direction ``step`` as a number, the nearest byte lowest; beyond ``count`` zero."""
    out = np.zeros(len(at), dtype=np.int64)
    for k in range(FLANK):
        there = count > k
        out[there] |= data[at[there] + step * k].astype(np.int64) << (8 * k)
    return out


def _cores(data, rows, shift, start, stop, anchor, length):
    """Second-level rows of a buffer: ``(rows, core hashes, left, right, low, high, start)``.

    Windows are taken by lead (anchor minus start) in groups of 8.  All windows of a group hold
    its core of ``length`` - 7 bytes; a window of rank t in the group adds the t bytes before
    the core and the 7 - t bytes behind it.  ``low`` and ``high`` are the ranks that occur.
    """
    lead_high, lead_low = anchor - start, anchor - (stop - length)
    groups = lead_high // 8 - lead_low // 8 + 1
    own = np.repeat(np.arange(len(start)), groups)
    group = lead_low[own] // 8 + np.arange(len(own)) - np.repeat(np.cumsum(groups) - groups, groups)
    low = np.maximum(lead_low[own] - 8 * group, 0)
    high = np.minimum(lead_high[own] - 8 * group, FLANK)
    core = anchor[own] - 8 * group
    at = core + shift[own]
    keys = []
    for family in (0, 1):
        hashed = window_hashes(run_hashes(data, 64, family), at, length - FLANK, family)
        keys.append(_stir((hashed + group.astype(np.uint64)) * _ODD[family][10]))
    left = _bytes_as_long(data, at - 1, -1, high)
    right = _bytes_as_long(data, at + length - FLANK, 1, FLANK - low)
    return rows[own], *keys, left, right, low, high, core - high


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """``(doc_id, text_key, lo, hi)``: byte ranges that cover exactly the windows of ``length`` bytes that start earlier too.

    Suffixes are radix sorted through their first ``length`` bytes only, most significant digit
    first, and a group of one leaves the sort at once:

    1. The first digit of a window is not its prefix but the 32-byte run in it with the
       smallest hash, which equal windows share at the same place.  About 35 neighbouring
       windows have the same one and go as one row, so the first pass moves a fraction of the
       suffixes.  Rows that agree in all bytes of their windows repeat each other whole.
    2. Where rows agree in the first digit only, the earliest of each kind goes on, eight
       neighbouring windows at a time: the second digit is the bytes that these share.
    3. The last digit is the up to 7 bytes before and behind, window by window.

    Every pass is grouped counts and minima and a join, never a gathered group, and linear in
    its rows, however many of them are equal.
    """
    texts = identified(docs)
    shared = first_digits(texts, length, False).groupBy("h").count().where("count > 1").select("h")
    rows = written(first_digits(texts, length, True).join(shared, "h"), "suffix-digits")
    place = F.shiftright("place", 16)
    rows = rows.select(
        "h", "c", "doc_id", "text_key", place.alias("anchor"),
        (place - F.expr("shiftright(place, 8) & 255")).alias("start"), (place - F.expr("place & 255") + length).alias("stop"),
    )
    whole, first = settle(rows, ["h"], ["c"], "suffix-first", "anchor")
    ranges = first.groupBy("doc_id", "text_key").agg(*(F.collect_list(c).alias(f"{c}s") for c in ("start", "stop", "anchor")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns = [batch.column(f"{c}s").to_pylist() for c in ("start", "stop", "anchor")]
        found = [_cores(*b, length) for b in _segments(unpacked(batch.column("packed")), columns)]
        if not found:
            return None
        rows, k, v, left, right, low, high, start = (np.concatenate(x) for x in zip(*found))
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(k.view(np.int64)), pa.array(v.view(np.int64)), pa.array(left), pa.array(right), pa.array((low << 8 | high).astype(np.int32))]
            + [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(start)],
            ["k", "v", "before", "behind", "ranks", "doc_id", "text_key", "start"],
        )

    cores = map_batches(
        _with(packed(texts), ranges, "inner"), run,
        "k long, v long, before long, behind long, ranks int, doc_id long, text_key long, start long",
    )
    cores = written(cores, "suffix-cores")
    discard(first)
    cores = cores.withColumn("stop", F.expr(f"start + (ranks & 255) - shiftright(ranks, 8) + {length}"))
    alike, second = settle(cores, ["k", "v"], ["before", "behind", "ranks"], "suffix-second")
    # A window of rank t starts t bytes before the core; ``start`` is that of the highest rank.
    single = second.withColumn("t", F.explode(F.expr("sequence(shiftright(ranks, 8), ranks & 255)"))).select(
        "k", "v", "t", "doc_id", "text_key",
        F.expr("before & (shiftleft(1L, 8 * t) - 1)").alias("before"),
        F.expr(f"behind & (shiftleft(1L, 8 * ({FLANK} - t)) - 1)").alias("behind"),
        F.expr("start + (ranks & 255) - t").alias("start"),
        F.expr(f"start + (ranks & 255) - t + {length}").alias("stop"),
    )
    single = written(single, "suffix-windows")
    discard(second)
    last, _ = settle(single, ["k", "v", "t", "before", "behind"], [], "suffix-last")
    return whole.unionByName(alike).unionByName(last)


def packed(texts: DataFrame) -> DataFrame:
    """``identified`` texts compressed, for shuffles that carry whole texts: ``doc_id, text_key, packed``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.array([len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in utf8(batch.column(2))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["doc_id", "text_key", "packed"])

    return map_batches(texts, run, "doc_id long, text_key long, packed binary")


def unpacked(column: pa.Array) -> list[bytes]:
    return [
        pa.decompress(v[8:], decompressed_size=int.from_bytes(v[:8], "little"), codec="zstd", asbytes=True) for v in column.to_pylist()
    ]


def _with(texts: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """Joins rows of ``identified`` texts with what was gathered for their doc_id and text."""
    other = per_text.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    return texts.join(other, texts["doc_id"].eqNullSafe(other["__id"]) & (texts["text_key"] == other["__key"]), how).drop("__id", "__key")


def cut(docs: DataFrame, length: int = 100) -> DataFrame:
    """``(doc_id, text_key, n_bytes, spans, kept)``: the maximal removed byte runs and the remaining bytes of every text.

    A byte is removed if a string of ``length`` UTF-8 bytes over it also starts earlier: in a
    smaller doc_id, or further ahead in the same text.  Matches overlap freely, stay inside a
    text and are judged on the input.

    Null texts are empty; texts shorter than ``length`` stay whole.  A null doc_id comes before
    all others.  Rows that share a doc_id stand at the same place: neither is earlier at equal
    starts, so repeated rows give equal results.  An empty table gives an empty result; other
    columns are ignored.
    """
    texts = identified(docs)
    ranges = repeated_ranges(docs, length).groupBy("doc_id", "text_key").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, spans, kept = [], [], []
        for text, lo, hi in zip(unpacked(batch.column("packed")), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
            merged = merge(lo, hi) if lo else []
            ends = [0] + [e for _, e in merged]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, [s for s, _ in merged] + [len(text)])))
            sizes.append(len(text))
            spans.append([{"start": s, "stop": e} for s, e in merged])
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
            ["doc_id", "text_key", "n_bytes", "spans", "kept"],
        )

    return map_batches(
        _with(packed(texts), ranges, "left"), run,
        "doc_id long, text_key long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary",
    )


def merge(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of ranges that touch or overlap."""
    order = np.argsort(lo)
    lo, hi = np.array(lo)[order], np.maximum.accumulate(np.array(hi)[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return list(zip(lo[new].tolist(), hi[np.concatenate((new[1:], [True]))].tolist()))
