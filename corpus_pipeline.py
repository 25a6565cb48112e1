"""The training-data pipeline: from raw documents to packed token sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metricwatch.llm import line_dedup, mixing, packing, simhash, toxicity
from metricwatch.sources import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't call toxic.

    Null and empty texts score the share of toxic labels; rows that share doc_id and text go or stay together.
    Without labelled documents of both kinds none goes.  An empty table gives an empty result; all columns stay.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; no document goes, a text may become empty.

    Null and empty texts stay as they are.  A null doc_id comes before all others; rows that share a doc_id stand at
    the same place.  An empty table gives an empty result; all columns stay, ``n_chars`` is counted anew.
    """
    return line_dedup.dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, then text key, then the other columns.

    Null, empty and wordless texts, also those that line dedup emptied, form one group.  A group whose ids are all
    null keeps one row too.  An empty table gives an empty result; all columns stay.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global random order.

    A null source counts as ''.  Rows with equal doc_id, also null ones, draw the same count; a source without any
    character has a mean of 1.  Equal places in the order are in no set order.  An empty table gives an empty result;
    the columns stay those of the input.
    """
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token sequences; ``row`` tells apart the copies of a document.

    Null and empty texts are the end token alone.  Rows with equal doc_id and text are packed each for itself.  An
    empty table gives an empty result; other columns are dropped.
    """
    return packing.pack(docs, TOKENIZER).drop("text_key")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
