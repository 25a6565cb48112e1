"""Column expressions.  All are built-in Spark functions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- statement log ---------------------------------------------------------


def warehouse_rate(warehouse: Column | str, rates: Mapping[str, int], default: int) -> Column:
    """Credits per hour for a warehouse name; unknown and NULL names get ``default``."""
    warehouse = _col(warehouse)
    by_rate: dict[int, list[str]] = {}
    for name, rate in rates.items():
        by_rate.setdefault(rate, []).append(name)
    expr = None
    for rate, names in by_rate.items():
        cond = warehouse.isin(*names)
        expr = F.when(cond, F.lit(rate)) if expr is None else expr.when(cond, F.lit(rate))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def compute_hours(elapsed_ms: Column | str) -> Column:
    """Milliseconds to hours, in DOUBLE."""
    return (_col(elapsed_ms) / F.lit(60000)) / F.lit(60)


def first_match(text: Column | str, pattern: str) -> Column:
    """First match of ``pattern``: case-insensitive, dot matches newline, NULL if none."""
    return F.regexp_substr(_col(text), F.lit("(?si)" + pattern))


def model_name(text: Column | str, pattern: str, suffix: str) -> Column:
    """Lower-case data-model name found in statement text, without the build suffix."""
    return F.replace(F.lower(first_match(text, pattern)), F.lit(suffix), F.lit(""))


def _int_div(n: Column, by: int) -> Column:
    # by is a power of 1024 and n < 2**63: a shift is exact where a DOUBLE quotient is not.
    return F.shiftright(n, by.bit_length() - 1)


def nice_bytes(n: Column | str) -> Column:
    """Bytes as text with two decimals, rounded half up in integer arithmetic."""
    n = _col(n).cast("bigint")
    expr = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB"), (5, "PB")):
        size = 1024**power
        rest = n % F.lit(size)
        whole = _int_div(n - rest, size)
        hundredths = _int_div(rest * 100 + size // 2, size)
        carried = whole + F.when(hundredths == 100, 1).otherwise(0)
        cents = F.when(hundredths == 100, 0).otherwise(hundredths)
        text = F.concat(
            carried.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"), F.lit(f" {unit}")
        )
        expr = expr.when(n < 1024 ** (power + 1), text) if power < 5 else expr.when(n.isNotNull(), text)
    return expr


# ---- dates and ratios ------------------------------------------------------


def month_start(day: Column | str) -> Column:
    return F.trunc(_col(day), "MM")


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    """``a / b`` in DOUBLE; 0 where ``b`` is 0 or either side is NULL."""
    return F.coalesce(_col(a) / F.nullif(_col(b), F.lit(0)), F.lit(0.0))


# ---- workspace features ----------------------------------------------------


def email_domain(email: Column | str) -> Column:
    """Text between the first and second ``@``; '' without one, NULL for NULL."""
    return F.split_part(_col(email), F.lit("@"), F.lit(2))


def server_key(*candidates: Column | str) -> Column:
    """First non-NULL candidate, trimmed."""
    return F.trim(F.coalesce(*[_col(c) for c in candidates]))


def above_floor(n: Column | str, floor: int) -> Column:
    """``n - floor``, never below 0; NULL stays NULL (``greatest`` would skip it)."""
    n = _col(n)
    return F.when(n - floor < 0, F.lit(0)).otherwise(n - floor)


def not_spider(device_type: Column | str) -> Column:
    """True unless the device is a spider; unknown (NULL) devices are kept."""
    return F.coalesce(_col(device_type), F.lit("Other")) != F.lit("Spider")


# ---- hashing ---------------------------------------------------------------


def hash_percent(key: Column | str, seed: int, buckets: int = 100) -> Column:
    """Stable bucket 0..buckets-1 of a key: same on any partitioning and any engine with md5."""
    digest = F.md5(F.concat_ws(":", _col(key).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def hash_uniform(*keys: Column) -> Column:
    """Uniform number in (0, 1) from a 64-bit hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53) + F.lit(2.0**-54)
