"""The subpackage's registered queries, ``name -> (spark, sf_dir) -> DataFrame``, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from metricwatch.llm import chat, divergence, extraction, line_dedup, line_quality, mixing, neighbours, packing, periods, secrets, simhash, sql, suffixes, toxicity

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_crf_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = ", ".join(f"'{k}'" for k in secrets.KINDS)
    joined = (
        "array_join(transform(sort_array(transform({}, s -> struct(s.start AS a, array_position(array(" + kinds + "), s.kind) AS k, s.stop AS b))),"
        " s -> concat_ws(':', element_at(array(" + kinds + "), cast(s.k AS int)), s.a, s.b)), ',')"
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"),
        F.expr(joined.format("concat(base, added)")).alias("spans"),
    )


@query
def op8_nb_ngram_toxicity(spark, sf_dir):
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op9_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query
def op2_posting_list_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_poisson_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op4_chat_windows(spark, sf_dir):
    # Conversation -7 quotes control strings.
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string"
    )
    return chat.digests(table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra))


@query
def op5_curve_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op6_line_frequency_quality(spark, sf_dir):
    return line_quality.assess(table(spark, sf_dir, "documents"))


@query
def op10_suffix_radix_dedup(spark, sf_dir):
    return suffixes.cut(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark, sf_dir):
    return periods.periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")


@query
def op13_html_extraction(spark, sf_dir):
    return extraction.main_text(table(spark, sf_dir, "pages"))


def oracle_sql() -> dict[str, str]:
    return dict(sql.TWINS)
