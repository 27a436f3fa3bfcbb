"""Hashes of words and of runs of words, for many texts at once in numpy.

A word's hash is a polynomial in a fixed odd base over random 64-bit values of
its bytes, taken from prefix sums modulo 2^64 and then mixed. Two different
words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .frames import LOWER

BASE = np.uint64(0x9E3779B97F4A7C15)
BLANKS = np.zeros(256, bool)
BLANKS[list(b" \t\n\x0b\x0c\r")] = True


@lru_cache(1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes, and words, that are worked on at once, so that a text of any length takes little more than its words' hashes.
SLICE = 1 << 20


@lru_cache(2)
def powers(inverse: bool) -> np.ndarray:
    base = np.uint64(pow(int(BASE), -1, 1 << 64)) if inverse else BASE
    out = np.full(SLICE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of bytes that are no breaks (a mask of 256), inside each of the texts that data holds end to end.

    lower: A-Z count as a-z. A run that goes on over slices has the hash that it would have in one.
    """
    values = byte_values()[LOWER] if lower else byte_values()
    found: list[list[np.ndarray]] = []
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        m, word = len(part), ~breaks[part]
        cuts = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, a + m, "left")] - a
        before = np.empty(m, bool)
        before[0] = False
        before[1:] = word[:-1]
        before[cuts] = False
        after = np.empty(m, bool)
        after[-1] = False
        after[:-1] = word[1:]
        after[cuts - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(values[part] * powers(False)[:m], out=sums[1:])
        own = [(sums[ends] - sums[starts]) * powers(True)[starts], starts + a, ends + a]
        if len(starts) and starts[0] == 0 and found and len(found[-1][2]) and found[-1][2][-1] == a and a not in offsets[np.searchsorted(offsets, a) :][:1]:
            last = found[-1]
            length = int(last[2][-1] - last[1][-1])
            last[0][-1:] += np.uint64(pow(int(BASE), length, 1 << 64)) * own[0][:1]
            last[2][-1] = own[2][0]
            own = [x[1:] for x in own]
            if not len(own[0]):
                continue
        found.append(own)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, starts, ends = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*found, strict=True))
    return mix(hashes), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts (lower: A-Z lower-cased), and where each text's words begin in them.

    data holds the texts end to end, offsets their bounds.
    """
    hashes, starts, _ = runs(data, offsets, BLANKS, lower)
    return hashes, np.searchsorted(starts, offsets)


def row_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow each other."""
    out = np.full(max(len(hashes) - n + 1, 0), n, np.uint64)
    for i in range(n):
        out = mix(out * BASE + hashes[i : len(hashes) - n + 1 + i])
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of n words of one text; of all its words if they are fewer; none without words."""
    if len(hashes) == 0:
        return hashes
    k = min(n, len(hashes))
    parts = [np.unique(row_hashes(hashes[a : a + SLICE + k - 1], k)) for a in range(0, len(hashes) - k + 1, SLICE)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
