"""Quality rules: fixed base rules, then a calibrated hashed n-gram classifier.

Words, word pairs and character 3- and 4-grams are hashed into one table of
``BUCKETS`` weights; within each of the four families a feature's value is its
share of the family. Texts are read in windows, and 3-word windows and lines are
compared by 64-bit hashes, so a very long text needs some 10 bytes a word beside
itself. A logistic regression is fitted on labelled rows and its output calibrated
(Platt) on rows left out of the fit. Texts are scored whole, in Arrow batches,
against the fixed threshold ``KEEP_FROM``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import mix64, slices, texts_of

BUCKETS = 1 << 15
#: Labelled rows used to fit and calibrate, at most about this many.
TRAINING_ROWS = 2500
ROUNDS = 30
RIDGE = 1e-4
#: Calibrated probability of quality from which on a text is kept.
KEEP_FROM = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50
_VOCABULARY = 200_000
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_IS_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))
# What counts as one code point of a word: neither white space nor a continuation byte.
_IS_LETTER = ~np.isin(np.arange(256), list(_SPACE)) & ((np.arange(256) & 0xC0) != 0x80)
_SHIFT = np.uint32(32 - 15)
_MULTIPLY, _STEP, _OTHER = np.uint32(2654435761), np.uint32(0x85EBCA6B), np.uint32(0x5BD1E995)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are looked at at once, so that memory beside the text itself doesn't grow with 50 bytes a character.
WINDOW = 1 << 20
_AT_ONCE = 1 << 23
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


class _Words(dict):
    """Hashes of words, so that a word met again isn't hashed again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_windows(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``WINDOW`` bytes, none of which ends inside a word."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + WINDOW)
        stop = gap.start() if gap else len(text)
        yield text[start:stop]
        start = stop


def sign_windows(text: bytes) -> Iterator[np.ndarray]:
    """The text's code points in parts of about ``WINDOW`` bytes, each part after the three code points before it."""
    start, before = 0, np.zeros(0, np.uint32)
    while start < len(text):
        stop = start + WINDOW
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        signs = np.frombuffer(text[start:stop].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        held = np.concatenate([before, signs])
        yield held
        start, before = stop, held[-3:]


def repeated_words(triples: list[np.ndarray]) -> int:
    """Words inside 3-word windows that occur twice or more, from the hashes of all windows in order.

    Hashes are counted in rounds of about ``_AT_ONCE`` distinct ones.
    """
    n = sum(map(len, triples))
    rounds = np.uint64(1 + n // _AT_ONCE)
    covered = np.zeros(n + 2, bool)
    for k in range(int(rounds) if n else 0):
        seen = [np.unique(part[part % rounds == k], return_counts=True) for part in triples]
        keys, place = np.unique(np.concatenate([found for found, _ in seen]), return_inverse=True)
        twice = keys[np.bincount(place, np.concatenate([times for _, times in seen])) > 1]
        first = 0
        for part in triples if len(twice) else ():
            at = np.flatnonzero(part % rounds == k)
            at = first + at[twice[np.minimum(np.searchsorted(twice, part[at]), len(twice) - 1)] == part[at]]
            for j in range(3):
                covered[at + j] = True
            first += len(part)
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    found, lines, start = [], 0, 0
    while start < len(text):
        end = text.find(b"\n", start + WINDOW)
        stop = end if end >= 0 else len(text)
        own = [xxhash.xxh3_64_intdigest(x) for x in text[start:stop].split(b"\n") if x and not x.isspace()]
        found.append(np.unique(np.array(own, np.uint64)))
        lines += len(own)
        start = stop + 1
    return lines - len(np.unique(np.concatenate(found))) if lines else 0


def word_buckets(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of words and of word pairs, and the hashes of 3-word windows; ``before`` holds the two words before."""
    all_words = np.concatenate([before, hashes])
    pairs = mix64(all_words[:-1] * _PAIR + all_words[1:])
    triples = mix64(pairs[:-1] * _PAIR + all_words[2:])
    new = pairs[max(0, len(before) - 1) :]
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), (new % np.uint64(BUCKETS)).astype(np.int64), triples


def sign_buckets(signs: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of character 3-grams and 4-grams, but for those inside the first ``known`` characters."""
    rolled = [signs]  # rolled[n] hashes the n + 1 characters from each place on
    for n in range(1, 4):
        rolled.append(rolled[-1][:-1] * _STEP + signs[n:] if len(signs) > n else signs[:0])
    three, four = rolled[2][max(0, known - 2) :], rolled[3][max(0, known - 3) :]
    return (three * _MULTIPLY >> _SHIFT).astype(np.int64), ((four ^ _OTHER) * _MULTIPLY >> _SHIFT).astype(np.int64)


def base_stats(text: bytes, n_words: int, triples: list[np.ndarray]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    letters = symbols = 0
    for k in range(0, len(text), WINDOW):
        raw = np.frombuffer(text, np.uint8, min(WINDOW, len(text) - k), k)
        letters, symbols = letters + int(_IS_LETTER[raw].sum()), symbols + int(_IS_SYMBOL[raw].sum())
    return n_words, letters, symbols, repeated_lines(text), repeated_words(triples)


def families(text: bytes, known: _Words, triples: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(family, bucket numbers) of a text's words (0), word pairs (1), character 3-grams (2) and 4-grams (3), window by window.

    The hashes of its 3-word windows are added to ``triples``.
    """
    before = np.zeros(0, np.uint64)
    for window in word_windows(text):
        hashes = known.of(window.split())
        words, pairs, threes = word_buckets(hashes, before)
        yield 0, words
        yield 1, pairs
        if triples is not None:
            triples.append(threes)
        before = np.concatenate([before, hashes[-2:]])[-2:]
    seen = 0
    for signs in sign_windows(text):
        three, four = sign_buckets(signs, seen)
        yield 2, three
        yield 3, four
        seen = min(3, len(signs))


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, text: bytes, known: _Words, triples: list[np.ndarray]) -> tuple[float, int]:
        """The text's margin and its number of words; the hashes of its 3-word windows are added to ``triples``."""
        total, count = [0.0] * 4, [0] * 4
        for family, buckets in families(text, known, triples):
            total[family] += float(self.weights[buckets].sum())
            count[family] += len(buckets)
        return self.bias + sum(t / n for t, n in zip(total, count, strict=True) if n), count[0]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], shares: dict[int, float] | None = None) -> Classifier:
    """Logistic regression on (label, buckets, values), calibrated on every fifth row.

    ``shares`` says which share of each label's rows was drawn. A row stands for
    the inverse of it in the calibration, so probabilities refer to the labels'
    natural ratio however many rows there are. Without rows of both labels there
    is nothing to learn: every text then gets the probability of the one label
    there is, or 1 without any.
    """
    labels = np.array([r[0] for r in rows], float)
    if len(set(labels)) < 2:
        sure = 20.0 if not len(labels) or labels[0] else -20.0
        return Classifier(np.zeros(BUCKETS, np.float32), 0.0, 0.0, sure)
    test = np.arange(len(rows)) % 5 == 4
    train = [r for r, t in zip(rows, test, strict=True) if not t]
    y = labels[~test]
    starts = np.cumsum([0, *(len(r[1]) for r in train)])[:-1]
    at = np.concatenate([r[1] for r in train]).astype(np.int64)
    value = np.concatenate([r[2] for r in train]).astype(np.float32)
    lengths = np.array([len(r[1]) for r in train])
    weight_of = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    weights, bias = np.zeros(BUCKETS), 0.0
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(1, ROUNDS + 1):
        margin = np.add.reduceat(np.append(value * weights[at], 0), starts) * (lengths > 0) + bias
        error = weight_of * (_sigmoid(margin) - y)
        slope = np.append(np.bincount(at, value * np.repeat(error, lengths), BUCKETS) + RIDGE * weights / BUCKETS, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        step = first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-12)
        weights -= 0.7 * step[:-1]
        bias -= 0.05 * step[-1]
    held = [r for r, t in zip(rows, test, strict=True) if t]
    margin = np.array([float((r[2] * weights[r[1].astype(np.int64)]).sum()) + bias for r in held])
    stands_for = np.array([1 / (shares or {}).get(r[0], 1.0) for r in held])
    slope, shift = _calibrate(margin, labels[test], stands_for)
    return Classifier(weights.astype(np.float32), bias, slope, shift)


def _calibrate(margin: np.ndarray, y: np.ndarray, stands_for: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with smoothed labels; each row counts as many times as it stands for."""
    each = stands_for / stands_for.mean()
    good, bad = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(float(margin.std()), 1e-6)
    z, ab = margin / spread, np.zeros(2)
    for _ in range(50):
        p = _sigmoid(ab[0] * z + ab[1])
        w = each * np.maximum(p * (1 - p), 1e-6)
        slope = np.array([(each * (p - goal) * z).sum(), (each * (p - goal)).sum()]) + 1e-3 * ab
        curve = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(ab[0] / spread), float(ab[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for part in slices(batches, "text"):
        at, value = [], []
        for text in texts_of(part, "text"):
            counts = np.zeros((4, BUCKETS))
            for family, buckets in families(text, known):
                counts[family] += np.bincount(buckets, minlength=BUCKETS)
            total = (counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).sum(axis=0)
            inside = np.nonzero(total)[0]
            at.append(inside.astype("<u2").tobytes()), value.append(total[inside].astype("<f4").tobytes())
        yield pa.record_batch(
            [part.column(0), part.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())],
            names=["doc_id", "quality", "at", "value"],
        )


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on rows of ``docs`` that ``labels`` (doc_id, quality 0 or 1) covers, at most about ``TRAINING_ROWS``."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    per = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    # As many rows of either label, as far as there are; a hash of doc_id chooses them.
    each = max(TRAINING_ROWS // 2, TRAINING_ROWS - min(per.values(), default=0))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20))
    share, shares = F.lit(0), {}
    for label, n in per.items():
        most = TRAINING_ROWS // 2 if n > TRAINING_ROWS // 2 and len(per) > 1 else min(n, each)
        shares[label] = min(1.0, most / n)
        share = F.when(F.col("quality") == label, int((1 << 20) * shares[label])).otherwise(share)
    chosen = F.broadcast(usable.where(draw < share))  # about TRAINING_ROWS rows of two numbers
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"
    )
    found = rows.mapInArrow(_features, "doc_id long, quality int, at binary, value binary").toArrow().sort_by("doc_id")
    return fit([
        (q, np.frombuffer(a, "<u2"), np.frombuffer(v, "<f4"))
        for q, a, v in zip(found["quality"].to_pylist(), found["at"].to_pylist(), found["value"].to_pylist(), strict=True)
    ], shares)


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality_score double"
)


def judge(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base statistics, base_failed, kept and the calibrated score.

    A null or empty text has no words and fails the base rules. Every row is
    judged by itself, so repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = _Words(), shared.value
        for part in slices(batches, "text"):
            stats, margins = [], []
            for text in texts_of(part, "text"):
                triples: list[np.ndarray] = []
                margin, n_words = model.margin(text, known, triples)
                stats.append(base_stats(text, n_words, triples))
                margins.append(margin)
            n, chars, symbols, lines, repeats = (np.array(x, np.int64) for x in zip(*stats, strict=True))
            failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
            score = model.probability(np.array(margins))
            columns = [n, chars, symbols, lines, repeats, failed, ~failed & (score >= KEEP_FROM), score]
            yield pa.record_batch([part.column(0), *map(pa.array, columns)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)
