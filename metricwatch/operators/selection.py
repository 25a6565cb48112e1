"""Exact order statistics of many columns by radix selection.

Doubles become unsigned integers of the same order.  Each pass counts, per column, how many cells
have which next bits behind the prefixes that are still of interest, and so narrows each wanted
rank to one bucket.  What moves are counts per bucket, never cells; a last pass fetches the
distinct values of the remaining buckets once these are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bits that one pass narrows, and cells in the remaining buckets at which their values are fetched.
PASS_BITS = 13
FEW_CELLS = 100_000


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles: -0 equals 0, all NaN are one value above infinity."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).astype(np.float64).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(2**63))).view(np.uint64)


def from_ordered_bits(keys: np.ndarray) -> np.ndarray:
    """The doubles of :func:`ordered_bits`."""
    bits = np.asarray(keys, np.uint64).view(np.int64)
    return np.where(bits < 0, bits & np.int64(2**63 - 1), ~bits).view(np.float64)


def _cells(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return ordered_bits(batch.column(column).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))


def _bucket_counts(active: dict[int, list[int]], done: int, width: int):
    """Task function: cells per (column, prefix, next ``width`` bits) of the active prefixes of ``done`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(c, p): np.zeros(1 << width, np.int64) for c, prefixes in active.items() for p in prefixes}
        for batch in batches:
            for c, prefixes in active.items():
                keys = _cells(batch, c)
                bucket = ((keys >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                head = keys >> np.uint64(64 - done) if done else np.zeros(len(keys), np.uint64)
                for p in prefixes:
                    sums[c, p] += np.bincount(bucket[head == np.uint64(p)], minlength=1 << width)
        for (c, p), counts in sums.items():
            used = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), c)), pa.array([str(p)] * len(used), pa.string()), pa.array(used), pa.array(counts[used])],
                ["column", "prefix", "bucket", "n"],
            )

    return run


def _values(active: dict[int, list[int]], done: int):
    """Task function: distinct cells below the active prefixes with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, prefixes in active.items():
                keys = _cells(batch, c)
                head = keys >> np.uint64(64 - done) if done else np.zeros(len(keys), np.uint64)
                found, n = np.unique(keys[np.isin(head, np.array(prefixes, np.uint64))], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), c)), pa.array(from_ordered_bits(found)), pa.array(n)], ["column", "value", "n"]
                    )

    return run


def order_statistics(cells: DataFrame, ranks: dict[int, set[int]], few_cells: int = FEW_CELLS) -> dict[tuple[int, int], float]:
    """The values at 0-based ranks, by ``(column number, rank)``, among each column's non-null doubles.

    ``cells`` is read once a pass, five times at most.  A pass sends at most 2^13 counts for each
    wanted rank and task, and one row for each to the driver.
    """
    spark = cells.sparkSession
    # (column, rank) -> (prefix so far, rank among the cells with that prefix, number of these)
    state = {(c, r): (0, r, None) for c, rs in ranks.items() for r in rs}
    done = 0
    while state:
        active: dict[int, list[int]] = {}
        for (c, _), (p, _, _) in state.items():
            if p not in active.setdefault(c, []):
                active[c].append(p)
        open_cells = {(c, p): n for (c, _), (p, _, n) in state.items()}
        if done == 64:
            return {key: float(from_ordered_bits(np.array([p], np.uint64))[0]) for key, (p, _, _) in state.items()}
        if done and sum(open_cells.values()) <= few_cells:
            return _fetched(cells, state, active, done)
        width = min(PASS_BITS, 64 - done)
        below = Window.partitionBy("column", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counted = (
            cells.mapInArrow(_bucket_counts(active, done, width), "column long, prefix string, bucket long, n long")
            .groupBy("column", "prefix", "bucket").agg(F.sum("n").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
        )
        wanted = spark.createDataFrame(
            [(c, r, str(p), inner) for (c, r), (p, inner, _) in state.items()], "column long, rank long, prefix string, inner long"
        )
        hit = counted.join(F.broadcast(wanted), ["column", "prefix"]).where("before <= inner AND inner < before + n")
        state = {
            (h["column"], h["rank"]): ((int(h["prefix"]) << width) | h["bucket"], h["inner"] - h["before"], h["n"]) for h in hit.collect()
        }
        done += width
    return {}


def _fetched(cells: DataFrame, state: dict, active: dict[int, list[int]], done: int) -> dict[tuple[int, int], float]:
    rows = cells.mapInArrow(_values(active, done), "column long, value double, n long").groupBy("column", "value").agg(F.sum("n").alias("n"))
    found: dict[int, list[tuple[int, int]]] = {}
    for row in rows.collect():
        found.setdefault(row["column"], []).append((int(ordered_bits(np.array([row["value"]]))[0]), row["n"]))
    out = {}
    for (c, r), (prefix, inner, _) in state.items():
        here = sorted(x for x in found[c] if x[0] >> (64 - done) == prefix)
        upto = np.cumsum([n for _, n in here])
        key = here[int(np.searchsorted(upto, inner, side="right"))][0]
        out[c, r] = float(from_ordered_bits(np.array([key], np.uint64))[0])
    return out


def column_quantiles(
    cells: DataFrame, counts: dict[str, int], probabilities: dict[str, float], few_cells: int = FEW_CELLS
) -> list[tuple[str, str, float]]:
    """Exact linearly interpolated quantiles ``(column, stat, value)`` of double columns.

    ``counts`` are the non-null cells of each column; columns without any give no row.  NaN is above all numbers.
    """
    places = {
        (c, stat): ((n - 1) * p, number)
        for number, (c, n) in enumerate(counts.items()) if n
        for stat, p in probabilities.items()
    }
    ranks: dict[int, set[int]] = {}
    for at, number in places.values():
        ranks.setdefault(number, set()).update((floor(at), ceil(at)))
    found = order_statistics(cells.select(*[F.col(f"`{c}`").cast("double") for c in counts]), ranks, few_cells)
    out = []
    for (c, stat), (at, number) in places.items():
        low, high = found[number, floor(at)], found[number, ceil(at)]
        out.append((c, stat, low if low == high else low + (high - low) * (at - floor(at))))
    return out
