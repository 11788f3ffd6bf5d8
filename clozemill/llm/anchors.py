"""Synchronising positions: places in a text chosen by its content alone."""

from __future__ import annotations

import numpy as np

from clozemill.llm.common import INVERSE, mixed, powers, prefix_hashes


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(data: np.ndarray, offsets: np.ndarray, gram: int, width: int):
    """Positions of grams that are least in some run of ``width`` grams of one text.

    Equal strings of ``gram + width - 1`` bytes hold an anchor at the same place in each. Returns the
    positions, their text numbers, the gram hashes there, and the prefix sums of the bytes.
    """
    n = len(data)
    sums = prefix_hashes(data.astype(np.uint16) + np.uint16(1))
    none = np.empty(0, np.int64)
    if n < gram + width - 1:
        return none, none, np.empty(0, np.uint64), sums
    hashes = mixed((sums[gram:] - sums[:-gram]) * powers(INVERSE, n)[:n - gram + 1])
    least = sliding(np.minimum, hashes, width)
    # Runs that cross the end of a text choose nothing: their value is above all hashes.
    length = gram + width - 1
    start = np.arange(len(least))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    crossing = start + length > offsets[1:][owner]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.where(crossing, np.uint64(0), least)
    pad = np.zeros(width - 1, np.uint64)
    # A gram is chosen where some run over it has exactly its hash as the least.
    best = sliding(np.maximum, np.concatenate([pad, low, pad]), width)
    chosen = np.flatnonzero((best == hashes) & (hashes != top) & (hashes != 0))
    owner = np.searchsorted(offsets, chosen, "right") - 1
    return chosen, owner, hashes[chosen], sums
