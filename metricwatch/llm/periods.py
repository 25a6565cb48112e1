"""Runs of words that repeat with a period, found by convolving blocks with the words behind them.

A run of period q and length 4 q or more holds, for the power of two B with B <= q < 2 B, a whole
block of B words that starts at a multiple of B and recurs q words later.  So at each scale B every
block is slid over the distances B to 2 B - 1 in the words behind it.  The sum of squared
differences of word numbers at all these distances is one convolution, done modulo a prime by a
number-theoretic transform; a sum of zero is an occurrence.  Occurrences are seeds: each is
extended over the words themselves to the whole run.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricwatch.llm.common import map_batches, utf8

# A run repeats its period at least four times and has at least six words.
MIN_LENGTH, REPEATS = 6, 4
# The prime 119 * 2^23 + 1 and its primitive root 3.  A real zero is zero modulo it; a sum that
# is zero only modulo the prime is found out when the seed is extended.
PRIME, ROOT = 998244353, 3
# Blocks shorter than this are summed directly: the transform would be longer than the sum.
DIRECT_BELOW = 8
CELLS = 1 << 20  # numbers transformed at a time
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


def _powers(root: int, n: int) -> np.ndarray:
    """1, root, root^2 ... modulo the prime."""
    out = np.ones(n, np.uint64)
    done, step = 1, root
    while done < n:
        out[done : 2 * done] = _mod(out[: min(done, n - done)] * np.uint64(step))
        done, step = 2 * done, step * step % PRIME
    return out


_TWIDDLES: dict[tuple[int, bool], list[np.ndarray]] = {}


def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """The factors of each pass of a transform of ``size``, longest first."""
    if (size, inverse) not in _TWIDDLES:
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        passes, half = [], size // 2
        while half:
            passes.append(_powers(pow(root, size // (2 * half), PRIME), half))
            half //= 2
        _TWIDDLES[size, inverse] = passes
    return _TWIDDLES[size, inverse]


def transform(x: np.ndarray) -> np.ndarray:
    """Transform of each row of ``x`` (length a power of two, values below the prime), in bit-reversed order."""
    rows, size = x.shape
    x = x.copy()
    for w in _twiddles(size, False):
        v = x.reshape(rows, -1, 2, len(w))
        a, b = v[:, :, 0], v[:, :, 1]
        total, less = a + b, a + (_P - b)
        v[:, :, 0] = np.where(total >= _P, total - _P, total)
        v[:, :, 1] = _mod(less * w) if len(w) > 1 else np.where(less >= _P, less - _P, less)
    return x


def back(x: np.ndarray) -> np.ndarray:
    """Rows whose transforms, in bit-reversed order, are ``x``."""
    rows, size = x.shape
    x = x.copy()
    for w in reversed(_twiddles(size, True)):
        v = x.reshape(rows, -1, 2, len(w))
        a, b = v[:, :, 0].copy(), v[:, :, 1]
        b = _mod(b * w) if len(w) > 1 else b.copy()
        total, less = a + b, a + (_P - b)
        v[:, :, 0] = np.where(total >= _P, total - _P, total)
        v[:, :, 1] = np.where(less >= _P, less - _P, less)
    return _mod(x * np.uint64(pow(size, PRIME - 2, PRIME)))


def squared_differences(blocks: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Modulo the prime: for each row and d = 0 .. B - 1 the sum over i of (blocks[i] - behind[d + i])^2.

    ``blocks`` are rows of B word numbers, ``behind`` rows of 2 B.
    """
    rows, width = blocks.shape
    reverse = np.zeros((rows, 2 * width), np.uint64)
    reverse[:, :width] = blocks[:, ::-1]
    # Entry B - 1 + d of the product is sum(blocks[i] * behind[d + i]); what wraps round lands before B - 1.
    product = back(_mod(transform(reverse) * transform(behind)))[:, width - 1 : 2 * width - 1]
    own = np.add.reduce(_mod(blocks * blocks), axis=1)
    squares = np.zeros((rows, 2 * width + 1), np.uint64)
    np.cumsum(_mod(behind * behind), axis=1, out=squares[:, 1:])
    theirs = squares[:, width : 2 * width] - squares[:, :width]
    return _mod(own[:, None] + theirs + np.uint64(2) * (_P - product))


def _direct_seeds(x: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of short periods, over the concatenated words of all texts: places from where enough words recur."""
    starts, distances = [], []
    for d in range(width, 2 * width):
        needed = max(MIN_LENGTH, REPEATS * d) - d
        if len(x) < d + needed:
            break
        sums = np.concatenate([[0], np.cumsum((x[d:] != x[:-d]) | (doc[d:] != doc[:-d]))])
        at = np.nonzero(sums[needed:] == sums[:-needed])[0]
        starts.append(at)
        distances.append(np.full(len(at), d))
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (np.zeros(0, int), np.zeros(0, int))


def _transform_seeds(x: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the blocks that start at ``first``, in texts that end at ``end``."""
    starts, distances = [], []
    offsets = np.arange(3 * width)
    step = max(1, CELLS // (2 * width))
    for at in range(0, len(first), step):
        s, e = first[at : at + step, None], end[at : at + step, None]
        place = s + offsets
        # Number 0 stands behind the end of a text; no word has it.
        words = np.where(place < e, x[np.minimum(place, len(x) - 1)], 0).astype(np.uint64)
        row, d = np.nonzero(squared_differences(words[:, :width], words[:, width:]) == 0)
        starts.append(s[row, 0])
        distances.append(d + width)
    return (np.concatenate(starts), np.concatenate(distances)) if starts else (np.zeros(0, int), np.zeros(0, int))


def _extent(x: np.ndarray, low: int, high: int, start: int, d: int) -> tuple[int, int]:
    """The longest stretch [a, b) around ``start`` in the text x[low:high] in which words d apart are equal."""
    b, step = start + d, 64
    while b < high:
        stop = min(b + step, high)
        wrong = x[b:stop] != x[b - d : stop - d]
        if wrong.any():
            b += int(wrong.argmax())
            break
        b, step = stop, step * 2
    a, step = start, 64
    while a > low:
        stop = max(a - step, low)
        wrong = (x[stop:a] != x[stop + d : a + d])[::-1]
        if wrong.any():
            a -= int(wrong.argmax())
            break
        a, step = stop, step * 2
    return a, b


class _Runs:
    """The runs of one text, found in order of their period."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, int]] = []  # start, end, period
        self.tried: dict[int, int] = {}  # distance -> end of the last stretch extended with it

    def add(self, x: np.ndarray, low: int, high: int, starts: np.ndarray, distances: np.ndarray, width: int) -> None:
        # A seed inside a run, at a multiple of its period, is that run again.
        fresh = np.ones(len(starts), bool)
        for a, b, q in self.found:
            fresh &= ~((starts >= a) & (starts + distances + width <= b) & (distances % q == 0))
        self.tried = {}
        for start, d in zip(starts[fresh].tolist(), distances[fresh].tolist()):
            if start < self.tried.get(d, -1):
                continue
            a, b = _extent(x, low, high, start, d)
            self.tried[d] = b - d
            if b - a >= max(MIN_LENGTH, REPEATS * d) and not any(
                p <= a and b <= e and d % q == 0 for p, e, q in self.found
            ):
                self.found.append((a, b, d))


def find_runs(x: np.ndarray, sizes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)``, by start and period, of texts that have any.

    ``x`` holds the texts' word numbers (from 1) one after the other, ``sizes`` their lengths.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    runs: dict[int, _Runs] = {}
    if not len(x):
        return {}
    # A word of a run occurs four times in its text at least, so a block with a rarer word starts no run.
    pairs, back_to, often = np.unique(doc * (int(x.max()) + 1) + x, return_inverse=True, return_counts=True)
    rare = np.concatenate([[0], np.cumsum(often[back_to] < REPEATS)])
    width = 1
    while len(sizes) and REPEATS * width <= sizes.max():
        if width < DIRECT_BELOW:
            starts, distances = _direct_seeds(x, doc, width)
        else:
            fits = np.nonzero(sizes >= REPEATS * width)[0]
            per_text = sizes[fits] // width
            texts = np.repeat(fits, per_text)
            number = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            first = begins[texts] + number * width
            alive = (rare[first + width] == rare[first]) & (first + 2 * width <= ends[texts])
            starts, distances = _transform_seeds(x, first[alive], ends[texts[alive]], width)
        if len(starts):
            owner = doc[starts]
            order = np.lexsort((starts, distances, owner))
            starts, distances, owner = starts[order], distances[order], owner[order]
            cuts = np.nonzero(np.diff(owner, prepend=-1, append=-1))[0]
            for lo, hi in zip(cuts, cuts[1:]):
                text = int(owner[lo])
                runs.setdefault(text, _Runs()).add(
                    x, int(begins[text]), int(ends[text]), starts[lo:hi], distances[lo:hi], width
                )
        width *= 2
    return {
        text: sorted((a - int(begins[text]), b - a, q) for a, b, q in r.found) for text, r in runs.items() if r.found
    }


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of a text's n places: in every tenth document a stretch is repeated."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; of equal ones the first, then that of the smaller period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string, "
    "runs_sha256 string, collapsed_sha256 string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
# Words held at a time; a longer text is taken by itself.
WORDS_A_STEP = 1 << 18


def _text_rows(ids: list, words: list[list[bytes]], plant: bool) -> list[tuple]:
    numbers: dict[bytes, int] = {}
    places = [planted(i, len(w)) if plant else np.arange(len(w)) for i, w in zip(ids, words)]
    coded = [
        np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in text), np.int64, len(text))[at]
        for text, at in zip(words, places)
    ]
    sizes = np.array([len(c) for c in coded])
    found = find_runs(np.concatenate(coded), sizes)
    rows = []
    for k, (doc_id, text, at) in enumerate(zip(ids, words, places)):
        runs = found.get(k, [])
        keep = np.ones(len(text), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        collapsed = b" ".join([text[i] for i in at[keep].tolist()] if runs or plant else text)
        best = _strongest(runs) if runs else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        rows.append((
            doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed,
            sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest(),
        ))
    return rows


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row: number of runs, the strongest run, all runs, the text without repeats and digests of both.

    Words lie between ASCII white space and are numbered from 0.  A run is a stretch with smallest
    period q and at least max(6, 4 q) words that no neighbouring word extends with the same period.  The
    strongest has the greatest length / period (ties: smallest start, then period); without runs
    ``start``, ``length``, ``period`` and ``exponent_milli`` are null.  ``collapsed`` are the words, joined by one
    blank, without those that a run contains after its first q.  ``plant`` repeats a stretch of
    every tenth document first (:func:`planted`), which gives tests and audits known runs.

    Null and empty texts have no words; their digests are those of empty strings.  Repeated rows give
    equal results, a null doc_id counts as the empty string in ``plant``.  Texts are whole, of any
    length.  An empty table gives an empty result; other columns are ignored.  Nothing is shuffled.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        held: list[list[bytes]] = []
        size = 0
        for text in utf8(batch.column(1)):
            held.append(text.split())
            size += len(held[-1])
            if size > WORDS_A_STEP:
                rows += _text_rows(ids[len(rows) : len(rows) + len(held)], held, plant)
                held, size = [], 0
        rows += _text_rows(ids[len(rows) :], held, plant) if held else []
        columns = list(zip(*rows))
        types = [pa.int64()] * 6 + [pa.list_(_RUN), pa.binary(), pa.string(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        arrays[7] = arrays[7].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, [f.split(": ")[0] for f in (
            "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256"
        )])

    return map_batches(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, SCHEMA)
