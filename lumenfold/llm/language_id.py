"""Language identification by words, backing off to character n-grams.

A known word scores its per-language log frequency. An unseen word is scored by
its longest known character n-grams: those of the longest length of which it
has any, down to single letters. Frequencies come from a bounded number of
labelled documents of each language; every word and n-gram of these is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import slices
from lumenfold.session import keep

#: Labelled documents of each language that the model is fitted on, at most about this many.
TRAINING_DOCUMENTS = 5_000
NGRAMS = (4, 3, 2, 1)
HELD_OUT = 5
SMOOTHING = 0.5
#: Documents of which a smaller share of the words is known, as a word or by its longest n-grams, are rejected by the pipeline.
LEAST_KNOWN = 0.25
#: How much of a word's evidence counts, as neighbouring words are not independent.
TEMPER = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
#: Words of texts whose evidence a worker remembers, and how many it adds up at once.
_REMEMBERED, _AT_ONCE = 300_000, 20_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its edges."""
    edged = f"<{word}>" if n > 1 else word
    return [edged[k : k + n] for k in range(len(edged) - n + 1)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 8 << 20):
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_lang.items():
            found = {0: words} | {n: Counter() for n in NGRAMS}
            for word, count in words.items():
                for n in NGRAMS:
                    for gram in grams_of(word, n):
                        found[n][gram] += count
            for n, counter in found.items():
                yield pa.record_batch(
                    [pa.array([lang] * len(counter)), pa.array([n] * len(counter), pa.int32()), pa.array(_hashes(counter).view(np.int64)),
                     pa.array(list(counter.values()), pa.int64())],
                    names=["lang", "kind", "entry", "n"],
                )


def _hashes(entries: Collection[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(e) for e in entries), np.uint64, len(entries))


class Table:
    """Entries' log probabilities per language relative to the languages' mean, as differences from those of an entry no language has.

    Only the languages that have an entry are held: ``where`` and ``more`` from
    ``starts[k]`` up to ``starts[k + 1]`` belong to the entry with number k. The
    entries themselves are held as sorted 64-bit hashes, a tenth of a dict's size;
    they are made in the tasks that count, so no entry reaches the driver as text.
    """

    def __init__(self, entries: np.ndarray, where: np.ndarray, count: np.ndarray, n_langs: int):
        """One row per entry (its hash) and language that has it."""
        order = np.lexsort((where, entries))
        entries = entries[order]
        starts = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]])[: len(entries)])
        self.hashes = entries[starts]
        self.starts = np.append(starts, len(entries)).astype(np.int32 if len(entries) < 2**31 else np.int64)
        self.where = where[order].astype(np.int32)
        self.more = np.log((count[order] + SMOOTHING) / SMOOTHING).astype(np.float32)
        self.base = np.log(SMOOTHING / (np.bincount(where, count, n_langs) + SMOOTHING * max(1, len(self.hashes)))).astype(np.float32)

    def find(self, entries: list[str]) -> np.ndarray:
        """The entries' numbers, -1 for those that aren't held."""
        wanted = _hashes(entries)
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """A row of all languages for each entry number."""
        lengths = (self.starts[at + 1] - self.starts[at]).astype(np.int64)
        held = np.repeat(self.starts[at + 1] - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        out = np.tile(self.base, (len(at), 1))
        out[np.repeat(np.arange(len(at)), lengths), self.where[held]] += self.more[held]
        return out - out.mean(axis=1, keepdims=True)


class Model:
    """Log probabilities per language of words (kind 0) and n-grams (kind n), each relative to the languages' mean.

    ``tables`` maps a kind to its table. Words met in texts get rows of a matrix
    of a fixed size.
    """

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, Table]):
        self.langs, self.prior, self.tables = langs, prior, tables
        self.known: dict[str, int] = {}
        self.rows = np.zeros((_REMEMBERED, len(langs) + 1), np.float32)

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row per word: its own, or the mean of its known n-grams of the longest length that has any.

        The last column is 1 if the word is known, or has a known n-gram of the
        longest length that fits it; it doesn't depend on the number of languages.
        """
        out = np.zeros((len(words), len(self.langs) + 1), np.float32)
        table = self.tables[0]
        at = table.find(words)
        out[at >= 0, :-1] = table.rows(at[at >= 0])
        out[at >= 0, -1] = 1
        left = np.nonzero(at < 0)[0]
        for n in NGRAMS:
            if not len(left):
                break
            table = self.tables[n]
            grams = [grams_of(words[k], n) for k in left.tolist()]
            at = table.find([g for own in grams for g in own])
            owner = np.repeat(np.arange(len(left)), [len(own) for own in grams])[at >= 0]
            found = np.bincount(owner, minlength=len(left))
            rows = table.rows(at[at >= 0])
            for k in range(len(self.langs)):
                out[left, k] = np.bincount(owner, rows[:, k], len(left)) / np.maximum(found, 1)
            longest = np.array([n == min(NGRAMS[0], len(words[k]) + 2) for k in left.tolist()])
            out[left, -1] = (found > 0) & longest
            left = left[found == 0]
        return out

    def __getstate__(self):
        return self.langs, self.prior, self.tables

    def __setstate__(self, state):
        self.__init__(*state)

    def total(self, words: list[str]) -> np.ndarray:
        """Summed evidence of the words, and how many of them are known."""
        total = np.zeros(len(self.langs) + 1)
        for k in range(0, len(words), _AT_ONCE):
            part = words[k : k + _AT_ONCE]
            if len(self.known) + len(part) > _REMEMBERED:
                self.known.clear()
            if new := [w for w in set(part) if w not in self.known]:
                first = len(self.known)
                self.rows[first : first + len(new)] = self.evidence(new)
                self.known.update(zip(new, range(first, first + len(new)), strict=True))
            at = np.fromiter(map(self.known.__getitem__, part), np.intp, len(part))
            total += self.rows[at].sum(axis=0, dtype=float)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, its probability and the share of known words for each text; ``und``, 0 and 0 without a letter or a model."""
        langs, scores, known = [], [], []
        for text in texts:
            if not text or not self.langs or not _LETTER.search(text):
                langs.append("und"), scores.append(0.0), known.append(0.0)
                continue
            words = words_of(text)
            *total, share = self.total(words)
            known.append(share / max(1, len(words)))
            logits = self.prior + TEMPER * np.array(total)
            odds = np.exp(logits - logits.max())
            best = int(odds.argmax())
            langs.append(self.langs[best]), scores.append(float(odds[best] / odds.sum()))
        return langs, scores, known


def train(docs: DataFrame) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text, lang) outside the held-out fold.

    Beyond ``TRAINING_DOCUMENTS`` rows of a language a share of them, chosen by a
    hash of doc_id and text, is used; the prior refers to all of its rows.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    rows = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    shares = {lang: TRAINING_DOCUMENTS / n for lang, n in rows.items() if n > TRAINING_DOCUMENTS}
    if shares:
        limits = F.create_map(*(F.lit(x) for lang, share in shares.items() for x in (lang, int((1 << 20) * share))))
        draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 20))
        usable = usable.where(draw < F.coalesce(limits[F.col("lang")], F.lit(1 << 20)))
    counted = usable.select("text", "lang").mapInArrow(_counts, "lang string, kind int, entry long, n long")
    totals = keep(counted.groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n")), "language-counts")
    per_lang = {r["lang"]: r["n"] / shares.get(r["lang"], 1.0) for r in totals.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(per_lang)
    place = {lang: k for k, lang in enumerate(langs)}
    prior = np.log(np.array([per_lang[lang] for lang in langs], float) + 1) if langs else np.zeros(0)
    tables = {}
    for kind in (0, *NGRAMS):
        found = totals.where(F.col("kind") == kind).select("entry", "lang", "n").toArrow()
        coded = found["lang"].combine_chunks().dictionary_encode()
        where = np.array([place[lang] for lang in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
        tables[kind] = Table(found["entry"].to_numpy().view(np.uint64), where, found["n"].to_numpy(), len(langs))
        del found, coded, where
        pa.default_memory_pool().release_unused()
    return Model(langs, prior - prior.mean() if langs else prior, tables)


def identify(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """Columns of ``docs`` with lang_pred, score and known added; every whole text is read.

    ``known`` is the share of words that the model knows, see :meth:`Model.evidence`.
    Text that is null or holds no letter is ``und`` with score 0, and so is all
    text under a model that learned no language. A column of ``docs`` that has
    one of these three names can't be among ``columns``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in columns if c != "text"] or ["doc_id"]
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
            langs, scores, known = shared.value.predict(list(texts))
            yield pa.record_batch(
                [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())],
                names=[*kept, "lang_pred", "score", "known"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{fields}, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without rows of no recognisable language: ``und``, or fewer than ``LEAST_KNOWN`` of the words known."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, _, known = shared.value.predict(list(part.column(at).to_numpy(zero_copy_only=False)))
            good = [lang != "und" and share >= LEAST_KNOWN for lang, share in zip(langs, known, strict=True)]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
