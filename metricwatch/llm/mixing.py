"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import shielded
from metricwatch.sources import written

# A mean above this is drawn as a sum of independent draws, so a distribution table stays short.
MEAN_PER_DRAW = 16.0
BROADCAST_SOURCES, SALTS = 5000, 64
DIGITS = 13  # hex digits of a draw: 52 bits


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from ``parts``; the same on every run and machine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def repetition_rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None,
                     temperature: float = 2.0, epochs: float = 1.0) -> DataFrame:
    """``(source, chars, rate)``: how often a document of each source is to appear on average.

    The mixture holds ``epochs`` times the characters of ``docs``.  A source's share is its
    weight in ``weights(source, weight)``, or without that ``chars ** (1 / temperature)``, over
    the weights of all sources that have characters.  Sources that ``weights`` leaves out get
    none.  A null source is the source ''.  A source of empty texts only has rate 1.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(
        F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("chars")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(1.0 / temperature)))
    else:
        named = weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(named, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = weighed.where("chars > 0").agg(F.sum("weight").alias("weights"), F.sum("chars").alias("chars")).first()
    weight_sum, char_sum = totals["weights"] or 0.0, totals["chars"] or 0
    rate = F.col("weight") / F.lit(weight_sum) * F.lit(char_sum) * F.lit(epochs) / F.col("chars") if weight_sum > 0 else F.lit(0.0)
    return weighed.select("source", "chars", F.when(F.col("chars") > 0, rate).otherwise(1.0).alias("rate"))


def _distributions(rates: DataFrame) -> DataFrame:
    """Adds ``draws`` and ``levels``: the Poisson distribution function of one draw, up to where it is 1 in double precision."""
    split = rates.withColumn("draws", F.greatest(F.ceil(F.col("rate") / MEAN_PER_DRAW), F.lit(1)).cast("int")).withColumn(
        "mean", F.col("rate") / F.col("draws")
    )
    return split.withColumn(
        "levels",
        F.expr(
            "aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean) + 20) AS int)),"
            " struct(exp(-mean) AS p, array(exp(-mean)) AS f),"
            " (a, k) -> struct(a.p * mean / k AS p, concat(a.f, array(element_at(a.f, -1) + a.p * mean / k)) AS f),"
            " a -> a.f)"
        ),
    )


def _beside(docs: DataFrame, source: str, rates: DataFrame) -> DataFrame:
    """Joins every row with its source's distribution without gathering a source's rows.

    Up to ``BROADCAST_SOURCES`` distributions (about a kilobyte each) are broadcast; of more,
    each is copied to ``SALTS`` keys and a source's rows are dealt out over them.
    """
    name = F.coalesce(F.col(source), F.lit(""))
    if rates.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates), name == F.col("__source"))
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn("__deal", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return dealt.join(salted, (name == F.col("__source")) & (F.col("__deal") == F.col("__salt"))).drop("__deal", "__salt")


def repetitions(docs: DataFrame, source: str, weights: DataFrame | None, temperature: float, epochs: float, seed: int) -> DataFrame:
    """``docs`` with ``__copies``: the Poisson count of each row, inverted from a number hashed from its doc_id."""
    rates = _distributions(repetition_rates(docs, source, weights, temperature, epochs)).select(
        F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("levels").alias("__levels")
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = F.transform(F.sequence(F.lit(0), F.col("__draws") - 1), lambda j: uniform(name, j.cast("string"), F.lit(str(seed))))
    joined = _beside(docs, source, written(rates, "mixing-rates")).withColumn("__u", u)
    count = F.expr("aggregate(__u, 0, (n, u) -> n + size(filter(__levels, f -> f <= u)))")
    return joined.withColumn("__copies", count).drop("__source", "__draws", "__levels", "__u")


@shielded
def mix(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, temperature: float = 2.0,
        epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` repeated to the target mixture in a global random order; adds ``copy`` (from 1) and ``shuffle_key``.

    Each row appears a Poisson number of times whose mean is its source's repetition rate, so
    the mixture meets the weights in expectation and no source has to be held or counted out.
    The order is the range-sorted hash of (doc_id, copy).  Names that ``docs`` already has for the two added
    columns are replaced.

    Rows with equal doc_id (also null ones) draw the same count.  Null and empty texts are
    repeated like any other.  An empty table gives an empty result.
    """
    plain = docs.drop("copy", "shuffle_key")
    counted = repetitions(plain, source, weights, temperature, epochs, seed)
    copies = counted.where("__copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, __copies)"))).drop("__copies")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws(":", name, F.col("copy").cast("string"), F.lit(f"order-{seed}")).cast("binary"))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    return keyed.orderBy("shuffle_key")
