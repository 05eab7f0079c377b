"""Excerpts of texts for the words of a query, from the texts alone: tokens are found and judged some texts at a time.

What a token, a term and a match are is said in ``operators/terms.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lumenfold.batches import slices
from lumenfold.functions.excerpts import CLOSE_TAG, CROP_WORDS, OPEN_TAG, window

#: Bytes of text that are looked through at once, and characters of a single longer one.
TEXT_AT_ONCE = WINDOW = 1 << 20
#: Distinct tokens whose verdict a task keeps for each word, before it forgets all.
JUDGED = 300_000
#: Kinds of characters beside those of no token: of a run (letters and digits), or a token by itself.
RUN, SIGN = 1, 2
#: The one character that makes two in lower case.
_DOTTED = "İ"
_SPANS = pa.list_(pa.struct([("no", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))


def _one(c: str) -> str:
    """A character of lower case; the two small sigmas, of which the place in a token decides, are one."""
    return "σ" if c == "ς" else c


@lru_cache(maxsize=1)
def _raised() -> dict[str, str]:
    """The characters that lower case changes, by the one they become."""
    raised: dict[str, str] = {"σ": "ς"}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if (low := c.lower()) != c:
            raised[low] = raised.get(low, "") + c
    return raised


def forms(wanted: list[str]) -> list[str]:
    """The characters of the words, each with those that become it in lower case."""
    return [c + _raised().get(c, "") for c in sorted({_one(c) for w in wanted for c in w})]


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits lead from one word to the other."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class Matcher:
    """Finds the matches of words, each with a typo budget; the last also matches as a prefix."""

    def __init__(self, words: list[tuple[str, int]], forms: list[str], bounds: list[int], kinds: list[int]):
        """``forms`` are those of the words' characters; at ``bounds`` the kind of characters changes to the one in ``kinds``."""
        self.words, self.verdicts = words, [{} for _ in words]
        self.codes = {same[0]: k for k, same in enumerate(forms, 1)}
        self.signs = np.repeat(np.array(kinds, np.uint16 if len(forms) < 1 << 14 else np.uint32), np.diff([*bounds, 0x110000]))
        for k, same in enumerate(forms, 1):
            for c in same:
                self.signs[ord(c)] |= k << 2

    def _judge(self, no: int, term: str) -> bool:
        (want, budget), term = self.words[no], term.lower()
        return term == want or no == len(self.words) - 1 and term.startswith(want) or budget > 0 and distance_within(term, want, budget)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens begin and end, the kinds of all characters and their codes, 0 if no word has them."""
        signs = np.empty(len(text), self.signs.dtype)
        for k in range(0, len(text), WINDOW):
            part = np.frombuffer(text[k : k + WINDOW].encode("utf-32-le"), np.uint32)
            signs[k : k + len(part)] = self.signs[part]
        kinds = (signs & 3).astype(np.uint8)
        signs >>= 2
        run, single = np.zeros(len(text) + 2, bool), kinds == SIGN
        run[1:-1] = kinds == RUN
        starts = np.flatnonzero(run[1:-1] & ~run[:-2] | single)
        ends = np.flatnonzero(run[1:-1] & ~run[2:] | single) + 1
        return starts, ends, kinds, signs

    def _at(self, piece: str, codes: np.ndarray) -> np.ndarray:
        """Where a piece of a word stands, in any case."""
        if len(piece) > len(codes):
            return np.empty(0, np.int64)
        found, n = codes[: len(codes) - len(piece) + 1] == self.codes[_one(piece[0])], len(codes)
        for k, c in enumerate(piece[1:], 1):
            found &= codes[k : n - len(piece) + 1 + k] == self.codes[_one(c)]
        return np.flatnonzero(found)

    def _candidates(self, want: str, budget: int, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Tokens that a word may match: of its budget + 1 pieces one stands in each of them unchanged, moved by as many places at most."""
        found, n = [], len(want)
        for k in range(budget + 1):
            low, high = n * k // (budget + 1), n * (k + 1) // (budget + 1)
            at = self._at(want[low:high], codes)
            token = np.searchsorted(starts, at, "right") - 1
            at, token = at[token >= 0], token[token >= 0]
            inside = (np.abs(at - starts[token] - low) <= budget) & (at + (high - low) <= ends[token])
            found.append(token[inside])
        return np.unique(np.concatenate(found))

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the tokens of a text begin and end, and its matches as rows (token, word, tokens covered), in order."""
        starts, ends, kinds, codes = self.tokens(text)
        found = []
        for no, (want, budget) in enumerate(self.words):
            tokens = np.arange(len(starts)) if _DOTTED in text else self._candidates(want, budget, starts, ends, codes)
            held = [text[a:b] for a, b in zip(starts[tokens].tolist(), ends[tokens].tolist(), strict=True)]
            verdicts = self.verdicts[no]
            if len(verdicts) > JUDGED:
                verdicts.clear()
            verdicts.update((t, self._judge(no, t)) for t in set(held) - verdicts.keys())
            tokens = tokens[np.array([verdicts[t] for t in held], bool)]
            found.append(np.stack([tokens, np.full_like(tokens, no), np.ones_like(tokens)], 1))
            if len(want) == 2 or len(want) == 1 and no == len(self.words) - 1:
                # Pairs of signs, whose scripts have no cases.
                at = self._at(want, codes)
                at = at[at + 1 < len(codes)]
                pairs = np.searchsorted(starts, at[(kinds[at] == SIGN) & (kinds[at + 1] == SIGN)])
                found.append(np.stack([pairs, np.full_like(pairs, no), np.full_like(pairs, 2)], 1))
        rows = np.concatenate(found)
        return starts, ends, rows[np.lexsort(rows.T[::-1])]


def marked(text: str, starts: np.ndarray, ends: np.ndarray, rows: list[tuple[int, int, int]], words: int = CROP_WORDS, before: str = OPEN_TAG, after: str = CLOSE_TAG) -> str:
    """What :func:`excerpts.excerpt` makes, from where the tokens begin and end."""
    n = len(starts)
    start, end = window(n, rows, words)
    starts, ends = starts[start:end].tolist(), ends[start:end].tolist()
    high = ends[-1] if end < n else len(text)
    out, at, close = ["…" if start else ""], starts[0] if start else 0, None
    for k in sorted({p + j - start for p, _, w in rows for j in range(w) if start <= p + j < end}):
        if starts[k] != close:
            if close is not None:
                out += text[at:close], after
                at = close
            out += text[at : starts[k]], before
            at = starts[k]
        close = ends[k]
    if close is not None:
        out += text[at:close], after
        at = close
    return "".join([*out, text[at:high], "…" if end < n else ""])


def _some(matcher: Matcher, texts: list[str]) -> tuple[list[str], pa.Array]:
    """The excerpts and spans of some texts, looked through as one: a line feed between them is no token's."""
    starts, ends, rows = matcher.matches("\n".join(texts))
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, begins)
    spots = np.searchsorted(rows[:, 0], first)
    found = []
    for k, text in enumerate(texts):
        (a, b), (c, d) = first[k : k + 2], spots[k : k + 2]
        if c == d and b - a <= CROP_WORDS:
            found.append(text)
            continue
        own = rows[c:d] - (a, 0, 0)
        found.append(marked(text, starts[a:b] - begins[k], ends[a:b] - begins[k], list(map(tuple, own.tolist()))))
    token, no, covered = rows.T
    of = np.repeat(begins[:-1], np.diff(spots))
    fields = [no, starts[token] - of, ends[token + covered - 1] - starts[token]]
    places = pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in fields], fields=list(_SPANS.value_type))
    return found, pa.ListArray.from_arrays(pa.array(spots.astype(np.int32)), places, type=_SPANS)


def cropped(batches: Iterator[pa.RecordBatch], matcher: Matcher) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over columns of which the last is the text: the others, excerpt and spans."""
    for part in slices(batches, "_text", TEXT_AT_ONCE):
        texts, places = _some(matcher, [t or "" for t in part.column(part.num_columns - 1).to_pylist()])
        yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string()), places], names=[*part.schema.names[:-1], "excerpt", "spans"])
