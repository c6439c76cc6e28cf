"""64-bit hashes of words and byte strings, vectorised over many texts."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = np.atleast_1d(x).astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers drawn from ``seed``."""
    return mix(np.arange(n, dtype=U64) + U64(seed << 20)) | U64(1)


BYTE = mix(np.arange(256, dtype=U64) + U64(77 << 20))
#: The same, A-Z hashed as a-z.
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]
_BASE = int(odd(1, 5)[0])
_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), _BASE, U64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: What parts words: space and the controls \x09 to \x0D.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))


def hash_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE,
               byte: np.ndarray = BYTE_FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each maximal run of bytes outside ``gap``, never across rows.

    Returns (hashes, byte position of each word, first word of each row, with
    the number of words at its end).
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = ~gap[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[row_starts] = inside[row_starts]
    position = np.flatnonzero(starts)
    if not len(position):
        return np.zeros(0, U64), position, np.zeros(rows + 1, np.int64)
    chars = data[inside]
    first = np.flatnonzero(starts[inside])
    lengths = np.diff(first, append=len(chars))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    values = byte[chars]
    values *= powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, first))
    return hashes, position, np.searchsorted(position, offsets)


_WORD = odd(16, 9)


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its ``n``-word shingles.

    A row with fewer words has its whole sequence as its only shingle, a row
    without words has none.
    """
    total = max(0, len(words) - n + 1)
    runs = np.zeros(total, U64)
    for k in range(n):
        runs += words[k:k + total] * _WORD[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a:b - n + 1]))
        elif b > a:
            short = (words[a:b] * _WORD[:b - a]).sum(dtype=U64)
            out.append(mix(np.asarray(short ^ U64((b - a) << 50))))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set, as two signed numbers."""
    a = mix(values ^ U64(0x5BD1E995)).sum(dtype=U64)
    b = mix(values ^ U64(0x1B873593 << 7)).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
