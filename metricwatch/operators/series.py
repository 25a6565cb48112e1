"""Daily series from raw event tables: one scan per source table for all its series."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, timedelta
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.config import SeriesSpec
from metricwatch.functions import not_spider

AsOf = date | Callable[[SeriesSpec], date]


def in_range(ts: Column, lower: date | None, as_of: date, inclusive: bool = False) -> Column:
    """``lower <= ts < as_of``, or through the end of ``as_of`` when ``inclusive``.

    The bounds are compared with the raw column, so they reach the file scan.
    """
    end = as_of + timedelta(days=1) if inclusive else as_of
    cond = ts < F.lit(end)
    if lower is not None:
        cond = cond & (ts >= F.lit(lower))
    return cond


def daily_series(
    df: DataFrame,
    ts: str,
    measure: Column,
    as_of: date,
    lower: date | None = None,
    inclusive: bool = False,
    where: Column | str | None = None,
) -> DataFrame:
    """``(ds, y)``: ``measure`` per calendar day.  Days without rows are absent, not zero."""
    when = F.expr(ts)
    if where is not None:
        df = df.where(where)
    return (
        df.where(in_range(when, lower, as_of, inclusive))
        .groupBy(F.to_date(when).alias("ds"))
        .agg(measure.alias("y"))
    )


def human_visits(traffic: DataFrame, registry: DataFrame) -> DataFrame:
    """Traffic rows whose user agent is registered and not a spider.

    Agents registered twice repeat their rows.  No broadcast hint: Spark broadcasts the
    registry while it is under the session's size limit and otherwise splits hot agents
    in its skew join, which the shuffle of the following aggregate allows.
    """
    people = registry.where(not_spider("device_type")).select("context_useragent")
    return traffic.join(people, "context_useragent")


def _spec_predicate(spec: SeriesSpec, as_of: date) -> Column:
    cond = in_range(F.col("ts"), spec.lower, as_of, spec.inclusive)
    return cond & F.expr(spec.where) if spec.where else cond


def _measure(spec: SeriesSpec, cond: Column) -> Column:
    if spec.measure == "count":
        return F.count(F.when(cond, F.lit(1))).cast("double")
    value = F.when(cond, F.expr(spec.column))
    if spec.measure == "sum":
        return F.sum(value).cast("double")
    if spec.measure == "avg":
        return F.avg(value).cast("double")
    if spec.measure == "distinct":
        return F.count_distinct(value).cast("double")
    if spec.measure == "approx_distinct":
        # A sketch per day: one shuffle, and it may share its source's scan.
        return F.approx_count_distinct(value).cast("double")
    raise ValueError(f"unknown measure {spec.measure!r}")


def series_of_source(df: DataFrame, specs: Iterable[SeriesSpec], as_of: AsOf) -> DataFrame:
    """All series of one source and one time column as ``(series, ds, y)``, in one scan.

    Each series is a conditional aggregate; map-side partial aggregation reduces a source
    to days x series before anything is shuffled.
    """
    specs = list(specs)
    df = df.withColumn("ts", F.expr(specs[0].ts))
    conds = [_spec_predicate(s, as_of(s) if callable(as_of) else as_of) for s in specs]
    df = df.where(reduce(lambda a, b: a | b, conds))
    aggs = []
    for i, (spec, cond) in enumerate(zip(specs, conds)):
        aggs.append(F.count(F.when(cond, F.lit(1))).alias(f"n_{i}"))
        aggs.append(_measure(spec, cond).alias(f"y_{i}"))
    daily = df.groupBy(F.to_date("ts").alias("ds")).agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(spec.name).alias("series"), F.col(f"n_{i}").alias("n"), F.col(f"y_{i}").alias("y")
            )
            for i, spec in enumerate(specs)
        ]
    )
    return (
        daily.select("ds", F.explode(cells).alias("c"))
        .where(F.col("c.n") > 0)
        .select("c.series", "ds", "c.y")
    )


def all_series(table: Callable[[str], DataFrame], specs: Iterable[SeriesSpec], as_of: AsOf) -> DataFrame:
    """Every configured series in one long frame.

    ``table`` looks a source up by name.  Distinct counts get their own scan: beside other
    aggregates Spark would repeat every row once per distinct set.
    """
    ordered = sorted(specs, key=_scan_key)
    parts = []
    for (source, _, _), group in groupby(ordered, key=_scan_key):
        parts.append(series_of_source(source_rows(table, source), group, as_of))
    return reduce(DataFrame.unionByName, parts)


def _scan_key(spec: SeriesSpec):
    return spec.source, spec.ts, spec.name if spec.measure == "distinct" else ""


def source_rows(table: Callable[[str], DataFrame], source: str) -> DataFrame:
    if source == "human_visits":
        return human_visits(table("daily_website_traffic"), table("user_agent_registry"))
    return table(source)
