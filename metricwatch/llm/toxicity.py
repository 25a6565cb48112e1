"""Toxicity from character n-grams: a linear classifier over naive-Bayes-scaled counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import identified, utf8
from metricwatch.llm.suffixes import packed, unpacked
from metricwatch.sources import written


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that the weights are fitted on, and rows of more than
    ``sample_bytes`` are not among them.  The naive Bayes counts use every labelled row's whole text."""

    sizes: tuple[int, ...] = (2, 3, 4, 5)
    bits: int = 18
    smoothing: float = 1.0
    scale: float = 100.0
    penalty: float = 1e-3
    rounds: int = 120
    sample_rows: int = 3000
    sample_bytes: int = 200_000
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Per n-gram bucket ``gain`` (log-count ratio times weight) and ``size`` (absolute ratio), the bias, and the labels' log odds."""

    gain: np.ndarray
    size: np.ndarray
    bias: float
    prior: float


_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and word index of every character n-gram of lower-cased words, between word marks."""
    marked = ["\x02" + w.decode("utf-8", "replace").lower() + "\x03" for w in words]
    sizes = np.array([len(w) for w in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    place, buckets, owners = np.arange(len(points)), [], []
    run = points.copy()
    for n in range(2, max(settings.sizes) + 1):
        run = run[:-1] * np.uint64(1_000_003) + points[n - 1 :]
        if n in settings.sizes:
            inside = place[: len(run)] + n <= end[: len(run)]
            mixed = (run[inside] ^ (run[inside] >> np.uint64(29))) * _ODD
            buckets.append((mixed >> np.uint64(64 - settings.bits)).astype(np.int32))
            owners.append(word[: len(run)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def text_counts(text: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often they occur."""
    words = Counter(text.split())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    buckets, owner = ngrams(list(words), settings)
    counts = np.fromiter(words.values(), float, len(words))[owner]
    distinct, inverse = np.unique(buckets, return_inverse=True)
    return distinct, np.bincount(inverse, counts)


def training_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` of the rows to learn from: labelled, and outside the held-out quarter of ids.

    An id with contradicting labels counts as toxic.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def log_count_ratios(texts: DataFrame, known: DataFrame, settings: Settings) -> tuple[np.ndarray, float]:
    """Naive Bayes log ratio of every bucket, from the documents that hold it, and the prior log odds.

    Tasks add up their documents, so a task sends at most one row per bucket and label; the
    result has a fixed size.
    """
    # Labels grow with the documents, so both sides are always dealt by id.
    rows = packed(texts).join(known.hint("merge"), "doc_id").select("packed", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, (1 << settings.bits) + 1), dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(unpacked(batch.column("packed")), batch.column("toxic").to_pylist()):
                sums[min(max(toxic, 0), 1)][text_counts(text, settings)[0]] += 1
                sums[min(max(toxic, 0), 1)][-1] += 1
        label, bucket = np.nonzero(sums)
        if len(label):
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(bucket), pa.array(sums[label, bucket])], ["label", "bucket", "n"])

    counted = rows.mapInArrow(run, "label long, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, (1 << settings.bits) + 1))
    found = counted.toPandas()
    sums[found["label"], found["bucket"]] = found["n"]
    documents = sums[:, -1:]
    share = (sums[:, :-1] + settings.smoothing) / (documents + 2 * settings.smoothing)
    return np.log(share[1] / share[0]), float(np.log((documents[1, 0] + 1) / (documents[0, 0] + 1)))


def fit(texts: DataFrame, known: DataFrame, settings: Settings) -> Model:
    """Logistic weights over ratio-scaled counts (divided by their absolute sum), by adaptive gradient steps.

    Fitted in one task on a sample of bounded size; without both labels the weights stay zero.
    """
    ratio, prior = log_count_ratios(texts, known, settings)
    short = texts.select("doc_id", F.octet_length("text").alias("n")).where(F.col("n") <= settings.sample_bytes).select("doc_id").distinct()
    drawn = known.join(short, "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(settings.sample_rows)
    chosen = written(drawn, "toxicity-sample")  # bounded, so every task may hold it
    rows = texts.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= settings.sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(i, t, y) for b in batches for i, t, y in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist())]
        known.sort()
        weight, bias = _descend([t for _, t, _ in known], [y for _, _, y in known], ratio, prior, settings)
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])

    found = rows.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, "weight binary, bias double").first()
    weight = np.frombuffer(found["weight"], float) if found else np.zeros(1 << settings.bits)
    gain = settings.scale * ratio * weight
    return Model(gain.astype(np.float32), np.abs(ratio).astype(np.float32), found["bias"] if found else prior, prior)


def _descend(texts: list[bytes], marks: list[int], ratio: np.ndarray, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias; features are held in blocks of texts, 12 bytes a text's n-gram."""
    weight, speed = np.zeros(len(ratio)), np.full(len(ratio), 1e-12)
    labels = np.clip(np.array(marks, dtype=float), 0, 1)
    if not len(labels) or labels.min() == labels.max():
        return weight, prior
    blocks = []
    for at in range(0, len(texts), 128):
        counts = [text_counts(t, settings) for t in texts[at : at + 128]]
        scaled = [n * ratio[b] for b, n in counts]
        blocks.append((
            np.concatenate([b for b, _ in counts]).astype(np.int32),
            np.concatenate([settings.scale * v / max(np.abs(v).sum(), 1e-9) for v in scaled]).astype(np.float32),
            np.repeat(np.arange(len(counts), dtype=np.int32), [len(v) for v in scaled]),
            labels[at : at + 128],
        ))
    bias, bias_speed = prior, 1e-12
    for _ in range(settings.rounds):
        slope, bias_slope = settings.penalty * weight, 0.0
        for buckets, values, row, own in blocks:
            error = 1 / (1 + np.exp(-np.bincount(row, values * weight[buckets], len(own)) - bias)) - own
            slope += np.bincount(buckets, values * error[row], len(weight)) / len(labels)
            bias_slope += error.sum() / len(labels)
        speed += slope * slope
        weight -= 0.5 * slope / np.sqrt(speed)
        bias_speed += bias_slope**2
        bias -= 0.5 * bias_slope / np.sqrt(bias_speed)
    return weight, float(bias)


class Scorer:
    """Scores texts by their words: an n-gram lies inside one word, so a text's sums are its words' sums."""

    def __init__(self, model: Model, settings: Settings, limit: int = 300_000):
        self.model, self.settings, self.limit = model, settings, limit
        self.forget()

    def forget(self) -> None:
        self.known, self.sums, self.n = {}, np.zeros((2, 1 << 16)), 0

    def learn(self, words: list[bytes]) -> None:
        buckets, owner = ngrams(words, self.settings)
        while self.n + len(words) > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], axis=1)
        self.sums[0, self.n : self.n + len(words)] = np.bincount(owner, self.model.gain[buckets], len(words))
        self.sums[1, self.n : self.n + len(words)] = np.bincount(owner, self.model.size[buckets], len(words))
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def scores(self, texts: list[bytes]) -> list[float]:
        out = []
        for text in texts:
            words = text.split()
            new = [w for w in set(words) if w not in self.known]
            if len(new) + self.n > self.limit:
                self.forget()
                new = list(set(words))
            if new:
                self.learn(new)
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            # The bias is fitted beside features that never cancel; without a word only the labels' share is known.
            gain, size = self.sums[:, at].sum(axis=1) if words else (0.0, 0.0)
            odds = gain / max(size, 1e-9) + self.model.bias if words else self.model.prior
            out.append(float(1 / (1 + np.exp(-odds))))
        return out


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, text_key, held_out, score, predicted)`` per row of ``docs``, scored on whole texts.

    Features are counts of hashed character n-grams inside words, each times its naive Bayes
    log-count ratio and over the sum of their absolute values; a logistic model weighs them.
    It learns from labelled ids outside the held-out quarter only.

    Null, empty and wordless texts get the share of toxic labels.  Rows with a null doc_id are scored and
    not held out.  Repeated rows get equal scores.  Empty ``docs`` give an empty result, empty labels
    one score for all; other columns are ignored.
    """
    texts = identified(docs)
    model = fit(texts, written(training_labels(labels), "toxicity-labels"), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            found = pa.array(scorer.scores(utf8(batch.column(2))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "text_key", "score"])

    scored = texts.mapInArrow(run, "doc_id long, text_key long, score double")
    return scored.select(
        "doc_id", "text_key", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay, ``text`` as it is.

    Null, empty and wordless texts score the share of toxic labels.  Where ``docs`` has no labelled texts of both
    kinds nothing is learned and all rows stay.
    """
    texts = identified(docs)
    model = fit(texts, written(training_labels(labels), "toxicity-labels"), settings)
    if not model.gain.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            scores = scorer.scores(utf8(batch.column("text")))
            kept = batch.filter(pa.array([s < settings.threshold for s in scores]))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
