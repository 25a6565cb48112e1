"""Near-duplicate groups by 64-bit SimHash, found with multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from metricwatch.llm.common import components, identified, map_batches, shielded, text_key, utf8
from metricwatch.sources import written

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words of the lower-cased text."""
    words = text.lower().split()
    if len(words) < width:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    runs = zip(*(words[i:] for i in range(width)))
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group of ``sizes`` consecutive hashes, the word whose bits more than half of them set.

    Bits are counted eight at a time in the bytes of a 64-bit word, 255 hashes before the
    bytes are widened.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    n = sizes[filled]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    per_group = (n + 254) // 255
    group_at = np.concatenate(([0], np.cumsum(per_group)[:-1]))
    inside = np.arange(per_group.sum()) - np.repeat(group_at, per_group)
    starts = np.repeat(first, per_group) + 255 * inside
    words = np.zeros(len(n), dtype=np.uint64)
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & LANES
        counts = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts.astype(np.int64), group_at, axis=0)
        for byte in range(8):
            words |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[filled] = words
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_key, fingerprint bigint)`` of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, hashes = [], []
        for text in utf8(batch.column(2)):
            own = shingle_hashes(text, width)
            sizes.append(len(own))
            hashes.append(np.array(own, dtype=np.uint64))
        words = majority_bits(np.concatenate(hashes), np.array(sizes))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(words.view(np.int64))], ["doc_id", "text_key", "fingerprint"]
        )

    return map_batches(identified(docs), run, "doc_id long, text_key long, fingerprint long")


def _ball(word: str, bits: range) -> F.Column:
    """``word`` and the words that differ from it in one of ``bits``."""
    flips = ", ".join(f"{word} ^ shiftleft(1L, {b})" for b in bits)
    return F.expr(f"array({word}, {flips})")


def close_pairs(prints: DataFrame, bucket_limit: int = 32) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints at 2 or fewer differing bits, directly or by a common partner.

    Two 32-bit segments index the fingerprints.  At distance 2 either the upper segments differ
    in one bit at most or the lower ones are equal, so each fingerprint looks up the ball of
    radius 1 of its upper segment and the exact value of its lower one, and whole distances are
    verified.  Of two neighbours only the one with the lower bit probes.

    A segment value of more than ``bucket_limit`` fingerprints would compare them pairwise.
    Those fingerprints, and the ones a single upper bit away, are linked through the whole
    64-bit ball of radius 1 instead: two fingerprints are within 2 bits exactly when their
    balls share a word, and every member of a shared word links to the word's smallest.
    """
    sides = prints.select(
        "fingerprint",
        F.shiftrightunsigned("fingerprint", 32).alias("upper"),
        F.expr("fingerprint & 4294967295L").alias("lower"),
    )
    full = [
        sides.groupBy(F.col(s).alias("value")).count().where(F.col("count") > bucket_limit).select("value")
        for s in ("upper", "lower")
    ]
    near = full[0].select(F.explode(_ball("value", range(32))).alias("upper"), F.lit(True).alias("near")).distinct()
    marked = written(
        sides.join(full[0].select(F.col("value").alias("upper"), F.lit(True).alias("full_upper")), "upper", "left")
        .join(near, "upper", "left")
        .join(full[1].select(F.col("value").alias("lower"), F.lit(True).alias("full_lower")), "lower", "left")
        .select("fingerprint", "upper", "lower", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("full_upper", "near", "full_lower"))),
        "simhash-segments",
    )
    flips = ", ".join(
        f"IF(upper & {1 << b}L = 0, upper | {1 << b}L, NULL)" for b in range(32)
    )
    upper, lower = marked.where("NOT full_upper"), marked.where("NOT full_lower")
    probes = (
        upper.select("fingerprint", F.lit(0).alias("part"), F.explode(F.expr(f"array_compact(array({flips}))")).alias("value"), F.lit(False).alias("same"))
        .unionByName(upper.select("fingerprint", F.lit(0).alias("part"), F.col("upper").alias("value"), F.lit(True).alias("same")))
        .unionByName(lower.select("fingerprint", F.lit(1).alias("part"), F.col("lower").alias("value"), F.lit(True).alias("same")))
    )
    table = upper.select(F.col("fingerprint").alias("other"), F.lit(0).alias("part"), F.col("upper").alias("value")).unionByName(
        lower.select(F.col("fingerprint").alias("other"), F.lit(1).alias("part"), F.col("lower").alias("value"))
    )
    found = (
        probes.join(table, ["part", "value"])
        .where("bit_count(fingerprint ^ other) <= 2 AND (NOT same OR fingerprint < other)")
        .select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))
    )
    balls = marked.where("near OR full_lower").select(
        F.col("fingerprint").alias("a"), F.explode(_ball("fingerprint", range(64))).alias("word")
    )
    smallest = balls.groupBy("word").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = balls.join(smallest, "word").where("a <> b AND bit_count(a ^ b) <= 2").select("a", "b")
    return found.unionByName(crowded).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, bucket_limit: int = 32) -> DataFrame:
    """``(doc_id, text_key, fingerprint, component_id, root)``, one row per row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of
    ``width`` words, repeats included; a shorter text is one shingle.  A bit of the fingerprint
    is set if more than half of the shingles' hashes set it.  Fingerprints that differ in 2 bits
    or fewer are linked, and ``component_id`` is the smallest doc_id that links reach; ``root`` is the group's smallest fingerprint.

    Null and wordless texts have fingerprint zero and are linked like any other.  Rows with a
    null doc_id get their group's smallest known id (null if there is none).  Repeated rows
    stay.  An empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, width), "simhash-prints")
    nodes = written(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "simhash-distinct"
    )
    groups = components(close_pairs(nodes.select("fingerprint"), bucket_limit), "simhash-stars")
    placed = nodes.join(groups, nodes["fingerprint"] == groups["node"], "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fingerprint", "component_id", "root"), "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "component_id", "root"
    )


@shielded
def keep_one(docs: DataFrame, width: int = 3, bucket_limit: int = 32) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id, then text key.

    All columns are kept.  Of rows equal in doc_id and text the first by the remaining simple
    columns stays.  A group whose ids are all null keeps one row too.
    """
    found = near_duplicates(docs, width, bucket_limit)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    chosen = found.groupBy("root").agg(first.alias("first")).select(
        F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key")
    )
    keyed = docs.withColumn("__text_key", text_key())
    kept = keyed.join(
        chosen, keyed["doc_id"].eqNullSafe(chosen["__id"]) & (keyed["__text_key"] == chosen["__key"]), "left_semi"
    )
    simple = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    order = Window.partitionBy("doc_id", "__text_key").orderBy(*simple)
    return kept.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
