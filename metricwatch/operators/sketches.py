"""Distinct counts from sketches kept per day: longer spans merge the days' sketches and read no events."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Binary logarithm of a sketch's registers; a day's sketch has a few kilobytes at most.
REGISTERS_LOG = 12
SPANS = ("day", "week", "month", "year")


def relative_error(registers_log: int = REGISTERS_LOG, deviations: float = 4.0) -> float:
    """Bound of the relative error: so many standard errors of 1.04 / sqrt(registers)."""
    return deviations * 1.04 / sqrt(2**registers_log)


def daily_sketches(events: DataFrame, ts: str, column: str, by: tuple[str, ...] = (), registers_log: int = REGISTERS_LOG) -> DataFrame:
    """``(by, ds, sketch)``: one sketch of the distinct non-null values of each day, combined before it shuffles."""
    return (
        events.where(F.col(column).isNotNull())
        .groupBy(*by, F.to_date(ts).alias("ds"))
        .agg(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(registers_log)).alias("sketch"))
    )


def distinct_by_span(sketches: DataFrame, span: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, start, distinct)`` of calendar spans, estimated from the days' sketches.

    A value that occurs on many days counts once.  Days without values have no sketch, spans without days no row.
    """
    if span not in SPANS:
        raise ValueError(f"unknown span {span!r}")
    start = F.date_trunc(span, "ds").cast("date").alias("start")
    return sketches.groupBy(*by, start).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def within(estimate: Column, exact: Column, registers_log: int = REGISTERS_LOG) -> Column:
    """Whether an estimate keeps the stated bound; below half of one value it counts as exact."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(relative_error(registers_log)) * exact, F.lit(0.5))
