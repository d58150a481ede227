"""Word and shingle hashes of many texts at once, in NumPy.

A word is a maximal run of letters or digits in lower case.  All texts of a batch
are laid out as one array of code points; words, their hashes and the hashes of
runs of consecutive words are then array expressions, without a Python loop over
words.
"""

from __future__ import annotations

import numpy as np

#: Code points below this are classified by one table; the few above, one by one.
_TABLE_SIZE = 0x30000


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(_TABLE_SIZE)), bool, _TABLE_SIZE)


def word_hashes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    codes = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
    wordy = table[np.minimum(codes, _TABLE_SIZE - 1)]
    for i in np.flatnonzero(codes >= _TABLE_SIZE):
        wordy[i] = chr(codes[i]).isalnum()
    edge = np.diff(wordy.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(edge == -1)
    length = ends - starts
    inside = codes[wordy].astype(np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat((inside + np.uint64(1)) * powers[place], first)
        hashes = mix64(sums + length.astype(np.uint64))
    upto = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(starts, upto), prepend=0)
    return hashes, counts


def run_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` consecutive words, and the text each belongs to."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = doc[:n] == doc[k - 1 :]
    return h[whole], doc[:n][whole]
