"""Words and word shingles as hashes.

Words are runs of ASCII letters, digits, underscores and characters beyond ASCII, in lower case. A text of fewer than
``width`` words but at least one has a single shingle, the sequence of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from .common import WORDS, Hashed, joined, mix, offsets, ranges, windows

WIDTH = 5


def lower_words(texts: list[str | None]) -> Hashed:
    return Hashed([x.lower().encode() if x else b"" for x in texts], WORDS)


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, repeats included, and how many each text has."""
    found = lower_words(texts)
    n, flat, at = found.n, found.flat, offsets(found.n)
    rolled = windows(flat, width)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    where, full = offsets(counts), n >= width
    out[ranges(where[:-1][full], counts[full])] = rolled[ranges(at[:-1][full], counts[full])]
    for size in range(1, width):  # texts of so many words
        some = np.flatnonzero(n == size)
        if len(some):
            value = np.full(len(some), size, dtype=np.uint64)
            for k in range(size):
                value = joined(value, flat[at[some] + k], 200 + k)
            out[where[some]] = mix(value, 7)
    return out, counts


def sets(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted, in a row; and how many each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[first], np.bincount(owner[first], minlength=len(counts))
