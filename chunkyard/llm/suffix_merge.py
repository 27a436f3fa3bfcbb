"""Front-coded runs of sorted strings, merged by a loser tree that knows common prefixes.

After Bingmann, Eberle and Sanders, "Engineering Parallel String Sorting", and
Bingmann, Sanders and Schimek, "Communication-Efficient String Sorting" (2020).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import zstandard


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes need no look."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while a[low : low + step] == b[low : low + step]:
        low += step
        step += step
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(strings: Sequence[bytes]) -> bytes:
    """A sorted run: for each string the length it shares with the one before, and the rest of it; compressed."""
    shared, rest, before = bytearray(), [], b""
    for s in strings:
        n = common(before, s)
        shared += n.to_bytes(2, "little") + (len(s) - n).to_bytes(2, "little")
        rest.append(s[n:])
        before = s
    return zstandard.ZstdCompressor(level=1).compress(len(strings).to_bytes(4, "little") + bytes(shared) + b"".join(rest))


def decode_run(blob: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a run, each with the length it shares with the one before."""
    b = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(b[:4], "little")
    at, s = 4 + 4 * n, b""
    for i in range(4, 4 + 4 * n, 4):
        shared, more = b[i] | b[i + 1] << 8, b[i + 2] | b[i + 3] << 8
        s = s[:shared] + b[at : at + more]
        at += more
        yield s, shared


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, length shared with the string before) over all runs, in order.

    Each waiting string's common prefix with the last winner is known. In a
    match, the longer one wins without a look at a byte; only equal ones are
    compared, from there on. Equal strings come in the order of their runs.
    """
    k = 1
    while k < len(runs):
        k *= 2
    waiting: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, run in enumerate(runs):
        waiting[i] = next(run, (None, 0))[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; what the loser shares with the winner is noted."""
        x, y = waiting[a], waiting[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common(x, y, shared[a])
        if n == len(x) == len(y):
            first = a < b
        elif n == len(x) or n == len(y):
            first = n == len(x)
        else:
            first = x[n] < y[n]
        winner, loser = (a, b) if first else (b, a)
        shared[loser] = n
        return winner, loser

    losers = [0] * k
    playing = list(range(k))
    level = k
    while level > 1:
        level //= 2
        pairs = [play(playing[2 * i], playing[2 * i + 1]) for i in range(level)]
        losers[level : 2 * level] = [loser for _, loser in pairs]
        playing = [winner for winner, _ in pairs]
    winner = playing[0] if playing else 0
    while runs and (s := waiting[winner]) is not None:
        yield winner, s, shared[winner]
        waiting[winner], shared[winner] = next(runs[winner], (None, 0))
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
