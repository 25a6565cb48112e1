"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.sources import written

# White space and words as the contracts define them (ASCII only).
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
# Bytes of rows that a Python worker gets at a time, and Spark's setting for it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_key(column: str = "text") -> Column:
    """Tells apart rows that share a doc_id; rows with equal id and text are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns that operators work on: doc_id, text_key and text (null text: empty)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(text).alias("text_key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets ``docs`` have columns named like an operator's own ones, which begin with ``__``: these get other names meanwhile."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (name for i in range(2 * len(taken) + 1) if (name := f"shielded_{i}") not in taken)
        hidden = {c: next(free) for c in docs.columns if c.startswith("__")}
        if not hidden:
            return operator(docs, *args, **kwargs)
        named = lambda v: hidden.get(v, v) if isinstance(v, str) else v
        found = operator(docs.withColumnsRenamed(hidden), *map(named, args), **{k: named(v) for k, v in kwargs.items()})
        return found.withColumnsRenamed({name: c for c, name in hidden.items()})

    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside send Python workers ``BATCH_BYTES`` at a time, where Spark's 64 MB may be a task's whole input.

    Spark doubles a batch's buffers as it fills them, and a worker holds the batch twice: as
    Arrow data and as texts.
    """
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(a, b)`` over bigint nodes: ``(node, root)``, root the smallest node.

    Alternating stars: every node's larger neighbours move to its smallest neighbour, then
    every node and its smaller neighbours do.  Both steps keep the components and each round
    is two grouped minima and two joins, so no component is ever held in one task; a round's
    edges are written to the shared folder.  Nodes without an edge are not returned.
    """
    links = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or state["n"] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(
            small.unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct(),
            label,
        )
