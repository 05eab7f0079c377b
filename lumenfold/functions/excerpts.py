"""A window of a text around its matches, with the matched tokens marked; and where these are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

OPEN_TAG, CLOSE_TAG = '<span style="color: red;">', "</span>"
#: Tokens that an excerpt has at most.
CROP_WORDS = 150


def window(n: int, matches: list[tuple[int, int, int]], words: int = CROP_WORDS) -> tuple[int, int]:
    """Tokens from, to: of the windows that begin at a match the one with most distinct words, the first if several, with its matches in the middle.

    ``matches`` are (position, word of the query, tokens covered), by position.
    """
    if n <= words:
        return 0, n
    held: dict[int, int] = {}
    best, low, high, right, every = 0, 0, 0, 0, len({word for _, word, _ in matches})
    for left, (start, word, _) in enumerate(matches):
        while right < len(matches) and matches[right][0] < start + words:
            held[matches[right][1]] = held.get(matches[right][1], 0) + 1
            right += 1
        if len(held) > best:
            best, low, high = len(held), start, max(p + w for p, _, w in matches[left:right])
        if best == every:
            break
        held[word] -= 1
        if not held[word]:
            del held[word]
    inside = min(high, low + words) - low
    start = min(max(low - (words - inside) // 2, 0), n - words)
    return start, start + words


def excerpt(pieces: list[str], token: list[bool], matches: list[tuple[int, int, int]], words: int = CROP_WORDS, before: str = OPEN_TAG, after: str = CLOSE_TAG) -> str:
    """The window as text: with an ellipsis where something was cut off, and tags around matched tokens; tokens side by side share them."""
    at = [k for k, t in enumerate(token) if t]
    start, end = window(len(at), matches, words)
    marked = {at[p + j] for p, _, w in matches for j in range(w) if start <= p + j < end}
    first = at[start] if start else 0
    last = at[end - 1] + 1 if end < len(at) else len(pieces)
    out, open_ = ["…" if start else ""], False
    for k in range(first, last):
        if (k in marked) != open_:
            open_ = not open_
            out.append(before if open_ else after)
        out.append(pieces[k])
    return "".join([*out, after if open_ else "", "…" if end < len(at) else ""])


def spans(pieces: list[str], token: list[bool], matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(word, start, length) of each match, in code points."""
    at, ends, where = [], [], 0
    for piece, t in zip(pieces, token, strict=True):
        if t:
            at.append(where)
            ends.append(where + len(piece))
        where += len(piece)
    return [(word, at[p], ends[p + w - 1] - at[p]) for p, word, w in matches]


def pieces_of(text: str, tokens: list[str]) -> tuple[list[str], list[bool]]:
    """The text cut into its tokens and what is between them, and which of the pieces are tokens; between them is no sign of a token."""
    pieces, token, at = [], [], 0
    for t in tokens:
        if (start := text.index(t, at)) > at:
            pieces.append(text[at:start])
            token.append(False)
        pieces.append(t)
        token.append(True)
        at = start + len(t)
    if at < len(text):
        pieces.append(text[at:])
        token.append(False)
    return pieces, token


def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over columns of which the last three are text, tokens, matches: the others, excerpt and spans, some rows at a time."""
    found = pa.list_(pa.struct([("no", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))
    for batch in batches:
        others = batch.num_columns - 3
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            texts, places = [], []
            for text, tokens, matches in zip(*(part.column(others + c).to_pylist() for c in range(3)), strict=True):
                pieces, token = pieces_of(text, tokens)
                order = sorted({(p, m["no"], m["width"]) for m in matches or [] for p in m["positions"]})
                texts.append(excerpt(pieces, token, order))
                places.append([{"no": no, "start": s, "length": n} for no, s, n in spans(pieces, token, order)])
            yield pa.record_batch([*part.columns[:others], pa.array(texts, pa.string()), pa.array(places, found)], names=[*part.schema.names[:others], "excerpt", "spans"])
