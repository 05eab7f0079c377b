"""Cutting stock by column generation, over a histogram of lengths.

The linear program minimises the number of sequences, one variable per pattern
(how many pieces of each length a sequence holds). It starts from patterns of a
single length; a knapsack by dynamic programming prices new patterns against
the program's duals until none improves it. Fractional patterns are rounded
down and what is left is filled best-fit decreasing.

The input is a histogram of at most ``capacity`` lengths, so its size does not
depend on the number of documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Stop when the program is within this share of its lower bound.
GAP = 1e-3
MOST_ROUNDS = 4000


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A matrix times a vector without BLAS: its threads have been seen to hang in a process that started a JVM."""
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges, without LAPACK for the same reason."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: best total value within ``capacity``, and the count of each size."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    ordered, worth = sizes[order], values[order]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(ordered, room, side="right")
        best[room] = best[room - 1]
        if fits:
            got = best[room - ordered[:fits]] + worth[:fits]
            k = int(got.argmax())
            if got[k] > best[room] + 1e-12:
                best[room], choice[room] = got[k], order[k]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def relax(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per column) and how often the linear program uses each, fractionally."""
    n = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns)) if n else np.zeros((0, 0))
    used = _times(inverse, demand)
    bound = 0.0
    for round_ in range(MOST_ROUNDS):
        duals = inverse.sum(axis=0)
        value, column = price(sizes, duals, capacity)
        bound = max(bound, float((duals * demand).sum()) / value)
        if value <= 1 + 1e-9 or used.sum() * (1 - GAP) <= bound:
            break
        direction = _times(inverse, column)
        rising = direction > 1e-11
        if not rising.any():
            break
        ratio = np.where(rising, used / np.where(rising, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        patterns[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if round_ % 200 == 199:  # undo the rounding errors that updates pile up
            inverse = _inverse(patterns)
            used = np.maximum(_times(inverse, demand), 0)
    return patterns.astype(np.int64), used


def cut(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns as (size -> pieces in one sequence, number of sequences) that hold every piece exactly once.

    Sizes run from 1 to ``capacity``. Each pattern's sequences are full copies of it.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    out: Counter = Counter()
    if not len(sizes):
        return []
    patterns, used = relax(sizes, left.astype(float), capacity)
    for k in np.argsort(-used):
        column = patterns[:, k]
        times = int(used[k] + 1e-9)
        inside = column > 0
        if inside.any():
            times = min(times, int((left[inside] // column[inside]).min()))
        if times > 0 and inside.any():
            left -= times * column
            out[tuple((int(s), int(c)) for s, c in zip(sizes[inside], column[inside], strict=True))] += times
    # What rounding left: fewer sequences than patterns, filled best-fit decreasing.
    room_of: list[list] = []
    for size, count in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
        while count:
            fitting = min((b for b in room_of if b[0] >= size), key=lambda b: b[0], default=None)
            if fitting is None:
                room_of.append(fitting := [capacity, Counter()])
            n = min(count, fitting[0] // size)
            fitting[0] -= n * size
            fitting[1][size] += n
            count -= n
    for _, held in room_of:
        out[tuple(sorted(held.items()))] += 1
    return [(dict(pattern), times) for pattern, times in out.items()]
