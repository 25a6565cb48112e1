"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.llm.common import identified, map_batches, utf8
from metricwatch.sources import written

END_ID = 1
BUCKETS, DIMENSIONS, BITS = 256, 3, 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_AXES = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


WORD_END = "\n"
MARK = b"\x1f"  # stands for a word that is encoded by itself
# Bytes of text encoded at a time; longer texts are cut at white space.
SLICE_BYTES = 1 << 20
_CUTS = re.compile(rb"(?s).{1,%d}[^\x20\x09-\x0D]*" % SLICE_BYTES)
_ODD = re.compile(rb"[\xc4-\xff\x1f]")  # in UTF-8: characters beyond Latin-1, and the mark

# How the tokenizer cleans and splits texts, which ``piece_ends`` repeats for Latin-1.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES, LETTER, NUMBER, OTHER = range(4)
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
_KINDS = np.array(
    [SPACES if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in map(chr, range(256))],
    dtype=np.uint8,
)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and its byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """A word-end byte-pair vocabulary as ranks, if ranks give the same ids as its list of merges.

    A rank table joins any two neighbours whose bytes are in the vocabulary, a list of merges
    only the listed pair.  They agree on all words if they do on every token's own bytes: whenever
    two symbols cover exactly a token's bytes, what happened inside them is what happens to
    these bytes alone.  ``None`` if that does not hold, ids do not follow the merges, or texts are cleaned and split in another way.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], [p.get("pattern", {}).get("Regex") for p in (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if (whole.get("normalizer") or {}).get("normalizers") != NORMALIZERS or split != [PIECES, None]:
        return None
    if any(t["normalized"] or not t["content"] or t["content"].split() != [t["content"]] for t in whole["added_tokens"]):
        return None
    if model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges"):
        return None
    symbols, end = byte_symbols(), WORD_END.encode()

    def raw(token: str) -> bytes:
        body = token.removesuffix("</w>")
        return bytes(symbols[c] for c in body) + end * (len(body) < len(token))

    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = {m: i for i, m in enumerate(merges)}
    ids = [model["vocab"][a + b] for a, b in merges]
    base = [t for t in model["vocab"] if t.removesuffix("</w>") in symbols]
    if ids != sorted(set(ids)) or len(base) != 512 or max(model["vocab"][t] for t in base) > ids[0]:
        return None
    for a, b in merges:
        parts = list((a + b).removesuffix("</w>"))
        if (a + b).endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), len(order)))
            if (parts[best], parts[best + 1]) not in order:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if parts != [a, b]:
            return None
    ranks = {raw(t): model["vocab"][t] for t in base if len(raw(t)) == 2 or raw(t) != end}
    ranks |= {raw(a + b): i for (a, b), i in zip(merges, ids)}
    ranks[end] = max(ranks.values()) + 1  # always joined to the byte before it
    return ranks


def piece_ends(data: np.ndarray) -> np.ndarray:
    """Where pieces of lower-case Latin-1 text end: runs of letters or of other characters, single numbers, and the seven endings behind a quote."""
    kind = _KINDS[data]
    ends = (kind != SPACES) & ((kind == NUMBER) | (kind != np.append(kind[1:], np.uint8(SPACES))))
    quotes = np.flatnonzero(data == ord("'"))
    quotes = quotes[(quotes == 0) | (kind[quotes - 1] != OTHER)]  # inside a run of other characters a quote is one of them
    padded = np.append(data, np.zeros(2, np.uint8))
    first, second = padded[quotes + 1], padded[quotes + 2]
    short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    long = np.isin(first.astype(np.uint16) << 8 | second, np.frombuffer(b"revell", ">u2"))
    ends[quotes[short | long]] = False
    ends[quotes[short] + 1] = True
    ends[quotes[long] + 2] = True
    return ends


class WordTokens:
    """Token ids (little-endian 32-bit bytes) of texts, encoded at once or looked up word by word.

    The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are
    the ids of its words.  With ``ranks`` all words in Latin-1 are encoded from the rank table, a slice
    of texts at a time; other words, and those with a special token, go through the tokenizer.  At most
    ``limit`` of such words, which repeat, are remembered.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None, limit: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = None
        if ranks:
            import tiktoken

            self.plain = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.ends[[i for b, i in ranks.items() if b.endswith(WORD_END.encode())]] = True
            self.mark = ranks[MARK + WORD_END.encode()]

    def learn(self, words: set[bytes]) -> None:
        """Afterwards the ids of these words, but not of all earlier ones, are in ``known``."""
        if new := words.difference(self.known):
            if len(self.known) + len(new) > self.limit:
                self.known, new = {}, words
            given = list(new)
            found = self.tokenizer.encode_batch([w.decode() for w in given], add_special_tokens=False)
            self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(given, found))

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        self.learn(set().union(*words))
        known = self.known.__getitem__
        return [b"".join(map(known, ws)) for ws in words]

    def _latin(self, text: bytes, odd: list[bytes]) -> bytes:
        """The text in Latin-1; words that it can't hold are added to ``odd`` and leave a mark."""
        if MARK not in text and not any(s in text for s in self.special):
            if text.isascii():
                return text
            try:
                return text.decode().encode("latin-1")
            except UnicodeEncodeError:
                pass
        words = text.split()
        for i, w in enumerate(words):
            if _ODD.search(w) or any(s in w for s in self.special):
                odd.append(w)
                words[i] = MARK
        return b" ".join(words).decode().encode("latin-1")

    def _at_once(self, texts: list[bytes]) -> list[bytes]:
        odd: list[bytes] = []
        latin = [self._latin(t, odd) for t in texts]
        data = np.frombuffer(b"\n".join(latin).translate(_LOWER), np.uint8)
        ends = piece_ends(data)
        times = (_KINDS[data] != SPACES).astype(np.int8) + ends  # a piece's last character and its end
        stream = np.repeat(data, times)
        stream[np.cumsum(times)[ends] - 1] = ord(WORD_END)
        ids = np.array(self.plain.encode_ordinary(stream.tobytes().decode("latin-1")), dtype="<u4")
        # The texts' places among characters, pieces and ids.
        upto = np.cumsum([len(t) + 1 for t in latin]) - 1
        upto = np.append(0, np.cumsum(ends))[upto]
        upto = np.append(0, np.flatnonzero(self.ends[ids]) + 1)[upto]
        marks = np.flatnonzero(ids == self.mark)
        self.learn(set(odd))
        whole, out, at = ids.tobytes(), [], 0
        for stop, a, b in zip(upto.tolist(), *np.searchsorted(marks, [np.append(0, upto[:-1]), upto]).tolist()):
            parts = []
            for place, word in zip(marks[a:b].tolist(), odd[a:b]):
                parts += [whole[4 * at : 4 * place], self.known[word]]
                at = place + 1
            out.append(b"".join([*parts, whole[4 * at : 4 * stop]]))
            at = stop
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        encode = self._at_once if self.plain else self._by_word
        out: list[list[bytes]] = [[] for _ in texts]
        rows, held, size = [], [], 0
        for row, text in enumerate(texts):
            for part in [text] if len(text) <= SLICE_BYTES else _CUTS.findall(text):
                rows.append(row)
                held.append(part)
                size += len(part)
                if size >= SLICE_BYTES:
                    for i, found in zip(rows, encode(held)):
                        out[i].append(found)
                    rows, held, size = [], [], 0
        if held:
            for i, found in zip(rows, encode(held)):
                out[i].append(found)
        return [b"".join(found) for found in out]


_LOADED: dict[str, WordTokens] = {}


def tokens_of(path: str, ranks: dict[bytes, int] | None) -> WordTokens:
    """One instance per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path, ranks)
    return _LOADED[path]


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Place of each row on a Hilbert curve through the cube of ``BITS`` bits a dimension.

    ``vectors`` are coordinates in [0, 1).  Skilling's transform of the coordinates to the
    transposed index, whose bits are then interleaved.
    """
    x = [np.minimum(c * (1 << BITS), (1 << BITS) - 1).astype(np.int64) for c in vectors.T]
    for bit in range(BITS - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(BITS - 1, 0, -1):
        turn = np.where(x[-1] & (1 << bit), turn ^ ((1 << bit) - 1), turn)
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> bit & 1)
    return key


def document_vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Token counts hashed to ``BUCKETS`` places, scaled to length 1, projected to ``DIMENSIONS`` and squeezed into (0, 1)."""
    counts = np.zeros((len(ids), BUCKETS))
    for row, own in enumerate(ids):
        place = (own.astype(np.uint64) * _MULTIPLIER) >> np.uint64(56)
        counts[row] = np.bincount(place.astype(np.int64), minlength=BUCKETS)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1.0)
    return 0.5 + 0.5 * np.tanh(counts @ _AXES)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, text_key, doc_tokens, curve, packed)``: each text's ids with ``end_id`` behind, zstd-compressed, and its place on the curve."""
    end = np.array([end_id], dtype="<u4").tobytes()
    ranks = docs.sparkSession.sparkContext.broadcast(merge_ranks(tokenizer))  # of the vocabulary's size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = tokens_of(tokenizer, ranks.value).ids(utf8(batch.column(2)))
        keys = curve_keys(document_vectors([np.frombuffer(i, "<u4") for i in ids]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(i) // 4 + 1 for i in ids], pa.int64()),
                pa.array(keys), pa.array([pa.compress(i + end, codec="zstd", asbytes=True) for i in ids], pa.binary()),
            ],
            ["doc_id", "text_key", "doc_tokens", "curve", "packed"],
        )

    return map_batches(identified(docs), run, "doc_id long, text_key long, doc_tokens long, curve long, packed binary")


def along_curve(rows: DataFrame) -> DataFrame:
    """``(row, at)``: the number of tokens before each row in the order of the curve.

    The rows are range-partitioned and sorted, which cuts through groups of equal keys.  Each
    partition's total is known before rows are numbered, so running sums stay inside partitions
    and only one row per partition is summed across.
    """
    order = ["curve", "doc_id", "text_key", "row"]
    placed = written(
        rows.select("doc_tokens", *order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "packing-order",
    )
    totals = placed.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("doc_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(bases, "part").select(
        "row", (F.col("base") + F.col("inside")).alias("at")
    )


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Pieces of token sequences: ``doc_id, text_key, row, start, length, ids, doc_tokens, sequence_id, offset``.

    Documents follow each other along a Hilbert curve through their projected token counts, so a
    sequence holds similar texts.  The stream is cut every ``length`` tokens: all sequences are
    full except the last.  A piece holds ``length`` ids from ``start`` of its document (which
    ends with ``end_id``) at ``offset`` of its sequence.  Ids are little-endian 32-bit numbers.

    Null and empty texts are the end id alone.  Repeated rows are documents of their own, told apart
    by ``row``; ties on the curve go by doc_id (null first) and text key.  An empty table gives an empty result;
    other columns are ignored.
    """
    rows = written(tokenised(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    placed = rows.join(along_curve(rows), "row")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, start, size, parts, sequence, offset = [], [], [], [], [], []
        for row, (data, n, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("packed", "doc_tokens", "at")))):
            ids, done = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), 0
            while done < n:
                inside = (at + done) % length
                take = min(n - done, length - inside)
                source.append(row)
                start.append(done)
                size.append(take)
                parts.append(ids[4 * done : 4 * (done + take)])
                sequence.append((at + done) // length)
                offset.append(inside)
                done += take
        source = pa.array(source)
        own = [batch.column(c).take(source) for c in ("doc_id", "text_key", "row", "doc_tokens")]
        number = lambda v: pa.array(v, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*own, number(start), number(size), pa.array(parts, pa.binary()), number(sequence), number(offset)],
            ["doc_id", "text_key", "row", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"],
        )

    return map_batches(
        placed.select("doc_id", "text_key", "row", "doc_tokens", "packed", "at"), run,
        "doc_id long, text_key long, row long, doc_tokens long, start long, length long, ids binary, sequence_id long, offset long",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: every packed sequence put together; a group is one sequence."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return whole.select(
        "sequence_id",
        F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
