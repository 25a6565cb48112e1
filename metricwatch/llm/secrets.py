"""Secrets by patterns, and by a linear-chain conditional random field that adds what patterns miss."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import identified, utf8
from metricwatch.sources import written

# The base patterns and least lengths.
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""((?i:{KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEYWORD_PARTS = ("passw", "secret", "token", "api")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LIKELY = rf"(?i)(?:{KEYWORDS})[\"']?\x20*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}"

# A token holds equals signs only at its end, as padding does, so a value is not one token with its name.
TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+(?:={1,2}(?![A-Za-z0-9+/_.=\-]))?|[^\sA-Za-z0-9+/_.\-]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
OFFSETS = (0, -1, -2, -3, 1)
FEATURES, BUCKETS = 4, 1 << 12
FILE_FEATURES, FILE_BUCKETS = 3, 8
NEVER = -1e4
NO_TOKENS = b"\0" * 4 * 3  # id 0, as often as the farthest neighbour is away

# How made training lines join a name and a value, and what made values consist of.
JOINTS = (" = ", "=", ": ", ":", " := ", " -> ", " is ", " ")
ALPHABETS = tuple(
    digits + letters
    for digits in ("0123456789",)
    for letters in ("abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")
)


@dataclass(frozen=True)
class Settings:
    """Of the ``candidate_rows`` texts with the smallest id hashes, the field is fitted on ``sample_rows`` that match a
    pattern and as many others, each of ``sample_bytes`` at most: on lines with a match, ``variants`` made from each, and
    every ``clean_lines``-th other line.  ``batch_bytes`` of text are tagged at once."""

    candidate_rows: int = 40_000
    sample_rows: int = 1200
    sample_bytes: int = 100_000
    clean_lines: int = 8
    variants: int = 6
    batch_bytes: int = 1 << 20
    rounds: int = 60
    penalty: float = 1e-4
    longest_chain: int = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORD_PARTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_SHAPE = {c: "a" if 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else "-" for c in range(128)}
_RUNS = re.compile(r"(.)\1+")


def token_features(token: str) -> tuple[int, ...]:
    """Buckets of a token's lower case, shape, alphabet with length, and first letters; bucket 0 is no feature.

    Only plain words and short marks have the first and the last: those of a random value say nothing.
    """
    shape = _RUNS.sub(r"\1", token.translate(_SHAPE)) if token.isascii() else "-"
    n, runs, letters = len(token), len(shape), token.isalpha()
    digits = 0 if letters else sum(c.isdigit() for c in token)
    alphabet = (
        "hex" if digits and not token.strip("0123456789abcdef") else "upper" if shape.strip("A0") == "" else
        "letters" if letters else "mixed"
    )
    kind = f"{alphabet} {min(n, 64).bit_length()} {4 * digits // n} {len(set(token)) * 4 // n}"
    shape = shape if runs <= 4 else f"{shape[0]} {min(runs // 3, 6)} {'-' in shape}"
    parts = [b"", b"1 " + shape.encode(), b"2 " + kind.encode(), b""]
    if n <= 3 or letters and n <= 20 and runs <= 2:
        parts[0], parts[3] = b"0 " + token.lower().encode(), b"3 " + token[:4].encode()
    return tuple(zlib.crc32(p) % (BUCKETS - 1) + 1 if p else 0 for p in parts)


def file_features(text: str) -> tuple[int, ...]:
    """Buckets of a text's length, its share of code marks and its share of digits."""
    n = max(len(text), 1)
    marks = sum(text.count(c) for c in "{}=;\"")
    digits = sum(text.count(c) for c in "0123456789")
    return min(n.bit_length() // 3, 7), min(200 * marks // n, 7), min(100 * digits // n, 7)


@dataclass(frozen=True)
class Field:
    """Weights by offset, feature, bucket and tag; by file feature; and between tags (row: from, last row: start)."""

    tokens: np.ndarray
    files: np.ndarray
    steps: np.ndarray


class Tagger:
    """Tags the lines of texts; remembers the scores of at most ``limit`` words' tokens.  Token 0 stands for no token."""

    def __init__(self, field: Field, limit: int = 150_000):
        self.field, self.limit = field, limit
        self.slack = 2 * max(0.0, float((field.steps[:3] - field.steps[0, 0]).max()), float((field.steps[3] - field.steps[3, 0]).max()))
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.n = {}, {}, 1
        self.scores = np.zeros((1 << 14, len(OFFSETS), 3))
        self.gains = np.zeros((len(OFFSETS), 1 << 14), dtype=np.float32)
        self.gains[0, 0] = -np.inf

    def _learn(self, words: list[bytes]) -> None:
        ids, first, new = self.ids, self.n, []
        for w in words:
            text = w.decode("utf-8", "replace")
            tokens = [text] if text.isalpha() and text.isascii() else TOKEN.findall(text)
            for token in tokens:
                if token not in ids:
                    ids[token] = first + len(new)
                    new.append(token)
            self.words[w] = b"".join([ids[t].to_bytes(4, "little") for t in tokens])
        if new:
            self.n += len(new)
            while self.n > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.gains = np.concatenate([self.gains, np.zeros_like(self.gains)], axis=1)
            buckets = np.array([token_features(t) for t in new])
            own = self.scores[first : self.n]
            for f in range(FEATURES):
                own += self.field.tokens[:, f, buckets[:, f]].transpose(1, 0, 2)
            self.gains[:, first : self.n] = (own[:, :, 1:].max(axis=2) - own[:, :, 0]).T

    def _encoded(self, lines: list[bytes]) -> list[bytes]:
        """Token ids of every line."""
        split = [line.split() for line in lines]
        new = set().union(*split).difference(self.words)
        if len(new) + len(self.words) > self.limit:
            self.forget()
            new = set().union(*split)
        self._learn(list(new))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def chains(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all lines, and the number of tokens of each."""
        data = self._encoded(lines)
        return np.frombuffer(b"".join(data), "<i4"), np.array([len(d) // 4 for d in data])

    def emissions(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tag scores of every token from itself and its neighbours in the line."""
        out = self.scores[ids, 0].copy()
        line = np.repeat(np.arange(len(sizes)), sizes)
        for role, offset in enumerate(OFFSETS[1:], 1):
            here, there = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
            same = line[here] == line[there]
            out[here][same] += self.scores[ids[there][same], role]
        return out

    def tags(self, text: bytes, decoded: str) -> list[tuple[int, np.ndarray]]:
        """``(line number, tags)`` of the lines whose best tagging is not all outside."""
        return self.tags_of([text], [decoded])[0]

    def tags_of(self, texts: list[bytes], decoded: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """``tags`` of several texts.

        A line is left out before decoding only if no token's advantage could outweigh the best
        steps between tags: then all outside is the best path.  A token's advantage is first bounded
        by the sum of the advantages that it and its neighbours give; lines within the bound are scored.
        """
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        if not self.field.tokens.any():
            return out
        split = [t.split(b"\n") for t in texts]
        counts = np.array([len(lines) for lines in split])
        data = self._encoded([line for lines in split for line in lines])
        ids = np.frombuffer(NO_TOKENS.join([b"", *data, b""]), "<i4")
        bound = self.gains[0][ids]
        for role, offset in enumerate(OFFSETS[1:], 1):
            here, there = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
            bound[here] += self.gains[role][ids[there]]
        files = np.array([sum(self.field.files[f, b] for f, b in enumerate(file_features(d))) for d in decoded])
        ease = self.slack + float((files[:, 1:].max(axis=1) - files[:, 0]).max())
        sizes = np.array([len(d) // 4 for d in data])
        stops = np.cumsum(sizes + len(NO_TOKENS) // 4)  # place behind each line
        lines = np.unique(np.searchsorted(stops, np.flatnonzero(bound + ease >= -1e-3), side="right"))
        if not len(lines):
            return out
        owner = np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        sizes = sizes[lines]
        scores = self.emissions(np.frombuffer(b"".join([data[i] for i in lines.tolist()]), "<i4"), sizes)
        scores += np.repeat(files[owner[lines]], sizes, axis=0)
        hopeful = scores[:, 1:].max(axis=1) - scores[:, 0] + self.slack >= 0
        stops = np.cumsum(sizes)
        for k in np.unique(np.searchsorted(stops, np.flatnonzero(hopeful), side="right")).tolist():
            best = viterbi(scores[stops[k] - sizes[k] : stops[k]], self.field.steps)
            if best.any():
                text = int(owner[lines[k]])
                out[text].append((int(lines[k] - first[text]), best))
        return out

    def spans(self, text: bytes, decoded: str) -> list[tuple[int, int]]:
        """Code point ranges of runs of a begin and its inside tokens."""
        return self.spans_of([text], [decoded])[0]

    def spans_of(self, texts: list[bytes], decoded: list[str]) -> list[list[tuple[int, int]]]:
        """``spans`` of several texts."""
        return [_ranges(text, found) if found else [] for text, found in zip(decoded, self.tags_of(texts, decoded))]


def _places(line: str) -> list[tuple[int, int]]:
    """Ranges of a line's tokens."""
    return [m.span() for w in WORD.finditer(line) for m in TOKEN.finditer(line, w.start(), w.end())]


def _ranges(text: str, found: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    lines = text.split("\n")
    starts = np.cumsum([0] + [len(line) + 1 for line in lines])
    out = []
    for i, tags in found:
        places, t = _places(lines[i]), 0
        while t < len(tags):
            end = t + 1
            if tags[t] == BEGIN:
                while end < len(tags) and tags[end] == INSIDE:
                    end += 1
                out.append((int(starts[i]) + places[t][0], int(starts[i]) + places[end - 1][1]))
            t = end
    return out


def viterbi(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best tags of one chain; ties go to the smaller tag."""
    best, back = scores[0] + steps[3], np.zeros((len(scores), 3), dtype=np.int8)
    for t in range(1, len(scores)):
        paths = best[:, None] + steps[:3]
        back[t] = paths.argmax(axis=0)
        best = paths.max(axis=0) + scores[t]
    tags = np.zeros(len(scores), dtype=np.int8)
    tags[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def _value(rng: random.Random, least: int) -> str:
    """A made value: at least ``least`` random characters, digits among them."""
    letters, n = rng.choice(ALPHABETS), rng.randint(least, 48)
    value = "".join(rng.choices(letters, k=n))
    return value if any(c.isdigit() for c in value) else rng.choice("0123456789") + value[1:]


def _plain(rng: random.Random, words: list[str], others: list[str]) -> str:
    """What stands behind a name without being a secret: a word, another token of the sample, a number or a version."""
    form = rng.randrange(5)
    if form < 2:
        return rng.choice(words)
    if form < 3:
        return rng.choice(others)
    if form < 4:
        return "".join(rng.choices("0123456789", k=rng.randint(1, 20)))
    return ".".join(str(rng.randrange(100)) for _ in range(rng.randint(2, 4)))


def _variant(line: str, cut: tuple[int, int], rng: random.Random, words: list[str], others: list[str], secret: bool):
    """The line with another name, joint and value instead of a match, and the range of the value if it is a secret."""
    joint, quote = rng.choice(JOINTS), rng.choice(("", "", '"', "'"))
    name = rng.choice(words) if rng.random() < 0.6 else f"{rng.choice(words)}_{rng.choice(words)}"
    if rng.random() < 0.2:
        name = joint = ""
    value = _value(rng, 10 if joint.strip() in ("=", ":", ":=") and joint else 18) if secret else _plain(rng, words, others)
    head = (line[: cut[0]] if rng.random() < 0.7 else "") + name + joint + quote
    tail = line[cut[1] :] if rng.random() < 0.7 else ""
    return head + value + quote + (" " + tail if tail else ""), [(len(head), len(head) + len(value))] if secret else []


def _training_chains(texts: list[str], settings: Settings):
    """Feature buckets, tags and file features of lines: all with a match, ``variants`` of each, and some others.

    Half of the variants are secrets behind other names, with made values of several alphabets and lengths;
    the others hold no secret in the same place.  Their file features are drawn, so that a value is not
    recognised by the file that it was found in.
    """
    chains, rows_of = [], []
    matched: list[tuple[str, tuple[int, int]]] = []
    known: dict[str, tuple[int, ...]] = {}

    def add(line: str, inside: list[tuple[int, int]], files: tuple[int, ...]) -> None:
        tags, rows, last = [], [], None
        for a, b in _places(line):
            hit = next((s for s in inside if a >= s[0] and b <= s[1] or a <= s[0] and b >= s[1] and s[1] - s[0] >= 0.8 * (b - a)), None)
            tags.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
            last = hit
            token = line[a:b]
            if token not in known:
                known[token] = token_features(token)
            rows.append(known[token])
            if hit is None:
                rows_of.append(token)
        for at in range(0, len(rows), settings.longest_chain):
            chains.append((np.array(rows[at : at + settings.longest_chain]), np.array(tags[at : at + settings.longest_chain]), files))

    for text in texts:
        files, start = file_features(text), 0
        spans = [(ASSIGN.match(text, a).span(2) if kind == 0 else (a, b), (a, b)) for a, kind, b in base_spans(text)]
        for number, line in enumerate(text.split("\n")):
            inside = [((a - start, b - start), (x - start, y - start)) for (a, b), (x, y) in spans if a < start + len(line) and b > start]
            start += len(line) + 1
            if inside:
                matched += [(line, (max(x, 0), y)) for _, (x, y) in inside]
            if inside or number % settings.clean_lines == 0:
                add(line, [value for value, _ in inside], files)
    words = sorted({t for t in rows_of if t.isalpha() and len(t) > 1}) or ["name"]
    others = sorted({t for t in rows_of if not t.isalpha() and len(t) > 3}) or ["0"]
    # Eighty characters on both sides hold all neighbours that features look at.
    for n, (line, cut) in enumerate(matched):
        rng = random.Random(zlib.crc32(line.encode()) + n)
        near = line[max(cut[0] - 80, 0) : cut[1] + 80]
        place = cut[0] - max(cut[0] - 80, 0), cut[1] - max(cut[0] - 80, 0)
        for v in range(settings.variants):
            made, inside = _variant(near, place, rng, words, others, v % 2 == 0)
            add(made, inside, tuple(rng.randrange(FILE_BUCKETS) for _ in range(FILE_FEATURES)))
    return chains


def fit_field(texts: list[str], settings: Settings) -> Field:
    """Maximises the likelihood of the training tags by adaptive gradient steps over forward and backward sums."""
    chains = sorted(_training_chains(texts, settings), key=lambda c: -len(c[0]))
    field = Field(
        np.zeros((len(OFFSETS), FEATURES, BUCKETS, 3)), np.zeros((FILE_FEATURES, FILE_BUCKETS, 3)), np.zeros((4, 3))
    )
    field.steps[[0, 3], INSIDE] = NEVER
    if not chains:
        return field
    sizes = np.array([len(c[0]) for c in chains])
    n, longest, total = len(chains), int(sizes[0]), int(sizes.sum())
    chain = np.repeat(np.arange(n), sizes)
    step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Every distinct token once; tokens refer to it.
    distinct, token = np.unique(np.concatenate([c[0] for c in chains]), axis=0, return_inverse=True)
    token = token.reshape(-1)
    tags = np.concatenate([c[1] for c in chains])
    files = np.array([c[2] for c in chains])
    roles = []
    for offset in OFFSETS:
        here = np.flatnonzero((step + offset >= 0) & (step + offset < sizes[chain]))
        roles.append((here, token[here + offset]))
    active = [int((sizes > t).sum()) for t in range(longest)]
    at = np.cumsum(sizes) - sizes  # place of each chain's first token
    gold_steps = np.zeros((4, 3))
    np.add.at(gold_steps[3], tags[at], 1)
    inner = np.flatnonzero(step > 0)
    np.add.at(gold_steps, (tags[inner - 1], tags[inner]), 1)
    speeds = [np.full(x.shape, 1e-8) for x in (field.tokens, field.files, field.steps)]
    for _ in range(settings.rounds):
        scores = sum(field.files[k, files[:, k]] for k in range(FILE_FEATURES))[chain]
        for r, (here, other) in enumerate(roles):
            own = sum(field.tokens[r, f, distinct[:, f]] for f in range(FEATURES))
            scores[here] += own[other]
        expected, steps = _expectations(np.exp(scores - scores.max(axis=1, keepdims=True)), field.steps, at, sizes, active)
        expected[np.arange(total), tags] -= 1
        slopes = [np.zeros_like(field.tokens), np.zeros_like(field.files), (steps - gold_steps) / total]
        for y in range(3):
            for r, (here, other) in enumerate(roles):
                summed = np.bincount(other, expected[here, y], len(distinct)) / total
                for f in range(FEATURES):
                    slopes[0][r, f, :, y] = np.bincount(distinct[:, f], summed, BUCKETS)
            per_chain = np.bincount(chain, expected[:, y], n) / total
            for k in range(FILE_FEATURES):
                slopes[1][k, :, y] = np.bincount(files[:, k], per_chain, FILE_BUCKETS)
        slopes[0][:, :, 0] = 0
        slopes[2][[0, 3], INSIDE] = 0
        for own, slope, speed in zip((field.tokens, field.files, field.steps), slopes, speeds):
            slope += settings.penalty * own * (own > NEVER / 2) / 100
            speed += slope * slope
            own -= 0.3 * slope / np.sqrt(speed)
    return field


def _expectations(potential: np.ndarray, steps: np.ndarray, at: np.ndarray, sizes: np.ndarray, active: list[int]):
    """Tag probabilities of every token and expected counts of steps, by scaled forward and backward products.

    Chains are ordered by length, so the first ``active[t]`` of them have a token at step t.
    """
    move, first = np.exp(steps[:3]), np.exp(steps[3])
    ahead, behind = np.zeros_like(potential), np.ones_like(potential)
    ahead[at] = potential[at] * first
    ahead[at] /= ahead[at].sum(axis=1, keepdims=True)
    for t in range(1, len(active)):
        here = at[: active[t]] + t
        now = (ahead[here - 1] @ move) * potential[here]
        ahead[here] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        here = at[: active[t]] + t
        back = (behind[here] * potential[here]) @ move.T
        behind[here - 1] = back / back.sum(axis=1, keepdims=True)
    marginal = ahead * behind
    marginal /= marginal.sum(axis=1, keepdims=True)
    counts = np.zeros((4, 3))
    counts[3] = marginal[at].sum(axis=0)
    inner = np.ones(len(potential), dtype=bool)
    inner[at] = False
    later = np.flatnonzero(inner)
    pair = ahead[later - 1][:, :, None] * move[None, :, :] * (behind[later] * potential[later])[:, None, :]
    counts[:3] = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, counts


def fit(texts: DataFrame, settings: Settings) -> Field:
    """Fits on a bounded sample in one task.  Only the texts of the sample's candidates are read and matched."""
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    last = texts.select(place.alias("place")).orderBy("place").limit(settings.candidate_rows).agg(F.max("place")).first()[0]
    if last is None:
        return fit_field([], settings)
    short = texts.where((place <= last) & (F.octet_length("text") <= settings.sample_bytes)).select(
        "text", place.alias("place"), F.col("text").rlike(LIKELY).alias("likely")
    )
    part = lambda flag: short.where(F.col("likely") == flag).orderBy("place", "text").limit(settings.sample_rows)
    sample = written(part(True).unionByName(part(False)), "secrets-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(t for b in batches for t in b.column(0).to_pylist())
        field = fit_field(rows, settings)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (field.tokens, field.files, field.steps)], ["a", "b", "c"]
        )

    found = sample.select("text").coalesce(1).mapInArrow(run, "a binary, b binary, c binary").first()
    if found is None:
        return fit_field([], settings)
    shapes = (len(OFFSETS), FEATURES, BUCKETS, 3), (FILE_FEATURES, FILE_BUCKETS, 3), (4, 3)
    return Field(*(np.frombuffer(found[c]).reshape(s) for c, s in zip("abc", shapes)))


def _groups(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """The texts in order, in groups of about ``limit`` bytes; a longer text is a group by itself."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, text_key, base, added)`` per row: base and added spans ``(kind, start, stop)`` in code points.

    Base spans are the patterns' matches.  The field tags a line's tokens as begin, inside or
    outside of a secret from their shape, three tokens before, one behind and features of the
    file, and adds spans that overlap no base span.  It is fitted to the patterns' values and to
    lines made from theirs, with other names, joints and values, or with no secret in that place.
    A sample in which no pattern matches gives a field that adds nothing.

    Null and empty texts have no spans.  Every line of a text is one chain, however long.
    Repeated rows get equal results.  An empty table gives an empty result; other columns are ignored.
    """
    texts = identified(docs)
    field = docs.sparkSession.sparkContext.broadcast(fit(texts, settings))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field.value)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            base, added = [], []
            for group in _groups(utf8(batch.column(2)), settings.batch_bytes):
                decoded = [text.decode() for text in group]
                for text, spans in zip(decoded, tagger.spans_of(group, decoded)):
                    own = base_spans(text)
                    base.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in own])
                    added.append([{"kind": KINDS[3], "start": a, "stop": b} for a, b in spans if all(b <= x or a >= y for x, _, y in own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, span), pa.array(added, span)], ["doc_id", "text_key", "base", "added"]
            )

    spans = "array<struct<kind: string, start: long, stop: long>>"
    return texts.mapInArrow(run, f"doc_id long, text_key long, base {spans}, added {spans}")
