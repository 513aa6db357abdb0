"""Counts and first rows of many windows over the same rows, without pairs: a small numpy helper of grouped tasks."""

from __future__ import annotations

import numpy as np


def _least(ranks: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least of each prefix of each row, by a running minimum of what the one before has passed on."""
    out, nothing = [], np.iinfo(ranks.dtype).max
    for _ in range(k):
        least = np.minimum.accumulate(ranks, axis=1)
        before = np.concatenate([np.full((len(ranks), 1), nothing), least[:, :-1]], axis=1)
        ranks = np.maximum(ranks, before)
        out.append(least)
    return np.stack(out, axis=-1)


def split_windows(at: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window ``low <= at <= high``, apart for ``value < bound`` and the others: how many rows it has, and its first ``k`` rows.

    Rows come in their order of preference; ``first`` holds their numbers, in order, ``len(at)`` where there are fewer. A merge sort tree: the rows by
    ``at`` in blocks of 1, 2, 4, ... rows, each by ``value``; a window is two blocks of each size at most. ``n log n`` in rows and windows.
    """
    n, nothing = len(at), np.iinfo(np.int64).max
    order = np.argsort(at, kind="stable")
    a, b = np.searchsorted(at[order], low, "left"), np.searchsorted(at[order], high, "right")
    ranked = np.sort(value)
    size = 1 << max(n - 1, 0).bit_length()
    rank = np.full(size, nothing)
    rank[:n] = order
    place = np.full(size, n, dtype=np.int64)
    place[:n] = np.searchsorted(ranked, value[order], "left")
    wall = np.searchsorted(ranked, bound, "left")
    counts, first = np.zeros((len(low), 2), dtype=np.int64), np.full((len(low), 2, k), nothing)
    block = 1
    while (a < b).any():
        rows = np.argsort(place.reshape(-1, block), axis=1, kind="stable")
        by_value, ranks = (np.take_along_axis(x.reshape(-1, block), rows, axis=1) for x in (place, rank))
        keys = (by_value + np.arange(len(by_value))[:, None] * (n + 2)).ravel()
        below, above = _least(ranks, k), _least(ranks[:, ::-1], k)
        left = (a < b) & (a % 2 == 1)
        right = (a + left < b) & (b % 2 == 1)
        for chosen, number in ((left, a), (right, b - 1)):
            i = np.flatnonzero(chosen)
            if not len(i):
                continue
            node = number[i]
            cut = np.searchsorted(keys, node * (n + 2) + wall[i], "left") - node * block
            real = np.minimum(n - node * block, block)  # the rest is padding, behind all values
            for side, many, least, upto in ((0, cut, below, cut), (1, real - cut, above, block - cut)):
                counts[i, side] += many
                some = np.flatnonzero(upto > 0)
                best = np.concatenate([first[i[some], side], least[node[some], upto[some] - 1]], axis=1)
                first[i[some], side] = np.sort(best, axis=1)[:, :k]
        a, b, block = (a + left) // 2, (b - right) // 2, block * 2
    return counts, np.minimum(first, n)
