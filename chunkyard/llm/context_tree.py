"""Context-tree weighting over bytes, each byte as eight binary decisions.

A context is the last 0 to DEPTH bytes. Every node of a context's binary tree
(the bits of the next byte so far) holds a Krichevsky-Trofimov estimate of its
own and is weighted with what its longer contexts give together:

    P = 1/2 KT + 1/2 product of P over the longer contexts

A context is held apart if it was seen LEAST times, whatever the corpus; the
rest of a context's data is one common branch, which also speaks for contexts
that were never seen. So the tree grows with the corpus. Counts are final
before scoring.

Only binary nodes that were met are worked on. Keys hold a context, its latest
byte highest, and the next byte; a node of a context is a run of its keys. The
subtrees of contexts of TOP + 1 bytes are apart from each other (`Layers`), and
what lies above them is a tree of its own that needs only their sums (`top`).
`build` is the same tree in one place, for small inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard

DEPTH = 6
#: Contexts seen less often share their parent's common branch. A fixed count, so that the tree is the same at every size.
LEAST = 2
#: The deepest contexts above the shards: at most 2^16.
TOP = 2
#: Keys whose subtrees are worked on at once, if they are more than one subtree.
PIECE = 1 << 18
#: Ends every text, and stands before it; UTF-8 never has this byte.
END = 255
LOG_HALF = np.log(0.5)
#: Contexts whose binary nodes are worked on at once.
PART = 2048


def grams(stream: np.ndarray) -> np.ndarray:
    """For each byte from DEPTH on: the DEPTH bytes before it and itself, as one number, the latest lowest."""
    x = stream.astype(np.uint64)
    n = len(x) - DEPTH
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(DEPTH + 1 if n > 0 else 0):
        out = out << np.uint64(8) | x[i : i + n]
    return out


def streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after DEPTH ends and with an end of its own; and where texts begin in it."""
    data = np.frombuffer(b"".join(bytes([END]) * DEPTH + t + bytes([END]) for t in texts), np.uint8)
    lengths = np.array([len(t) + DEPTH + 1 for t in texts], np.int64)
    return data, np.cumsum(lengths) - lengths + DEPTH


def counted_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts, sorted, and their counts."""
    data, starts = streams(texts)
    own = np.ones(len(data), bool)
    own[(starts[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    return np.unique(grams(data)[own[DEPTH:]], return_counts=True)


def _turned(data: np.ndarray) -> np.ndarray:
    """For each byte from DEPTH on: the DEPTH bytes before it, the latest highest, and itself lowest."""
    x, n = data.astype(np.uint64), len(data) - DEPTH
    out = np.zeros(max(n, 0), np.uint64)
    for i in [*range(DEPTH - 1, -1, -1), DEPTH] if n > 0 else []:
        out = out << np.uint64(8) | x[i : i + n]
    return out


def turned_grams(texts: list[bytes]) -> np.ndarray:
    """For each byte of each text and its end, in order: the DEPTH bytes before it, the latest highest, and itself lowest."""
    data, starts = streams(texts)
    own = np.ones(len(data), bool)
    own[(starts[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    return _turned(data)[own[DEPTH:]]


def gram_runs(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """`turned_grams` of texts, with the number of the first text and where each one's begin; a text of more than `size` bytes alone, in slices."""
    small: list[bytes] = []
    for i, text in enumerate([*texts, None]):
        if small and (text is None or len(text) > size):
            yield turned_grams(small), i - len(small), np.cumsum([0, *(len(t) + 1 for t in small[:-1])])
            small = []
        if text is not None and len(text) > size:
            for a in range(0, len(text) + 1, size):
                part = text[max(a - DEPTH, 0) : a + size]
                whole = bytes([END]) * max(DEPTH - a, 0) + part + (bytes([END]) if a + size > len(text) else b"")
                yield _turned(np.frombuffer(whole, np.uint8)), i, np.zeros(1, np.int64)
        elif text is not None:
            small.append(text)


class Counter:
    """Counted grams of any number of texts, merged whenever a bounded number waits."""

    def __init__(self, waiting: int = 1 << 21) -> None:
        self.waiting, self.held, self.n = waiting, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.n += len(keys)
        if self.n > self.waiting and len(self.held) > 1:
            self.held = [self.total()]
            self.n, self.waiting = len(self.held[0][0]), max(self.waiting, 2 * len(self.held[0][0]))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return merged(*(np.concatenate(x) for x in zip(*self.held, strict=True)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, place = np.unique(keys, return_inverse=True)
    return out, np.bincount(place, counts, len(out)).astype(np.int64)


def frequent(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of counted grams that hold all data of their contexts: context and next byte, for contexts of at least `least`."""
    keys, counts = merged(keys & np.uint64((1 << 8 * (depth + 1)) - 1), counts)
    contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
    enough = np.bincount(place, counts, len(contexts)) >= least
    return keys[enough[place]], counts[enough[place]]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def _zeros_ones(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones at the 255 binary nodes (1 to 255 in heap order) from counts of 256 bytes."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for level in range(7, -1, -1):
        first = 1 << level
        heap[:, first : 2 * first] = heap[:, 2 * first : 4 * first : 2] + heap[:, 2 * first + 1 : 4 * first : 2]
    return heap[:, 2:512:2], heap[:, 3:512:2]


#: Logs of Gamma(n + 1/2) / Gamma(1/2) and of Gamma(n + 1) for small n.
HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096) - 0.5))])
WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def _log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """`_log_kt` for one level of nodes, small counts from tables."""
    n = zeros + ones
    if not (large := n >= len(WHOLES)).any():
        return HALVES[zeros] + HALVES[ones] - WHOLES[n]
    out, small = np.empty(len(n)), ~large
    out[small] = HALVES[zeros[small]] + HALVES[ones[small]] - WHOLES[n[small]]
    out[large] = _log_kt(zeros[large].astype(float), ones[large].astype(float))
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of so many zeros and ones."""
    out = np.zeros(zeros.shape)
    seen = (zeros + ones) > 0
    a, b = zeros[seen], ones[seen]
    out[seen] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys without the earliest byte of their contexts."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and each key's run."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


class Layers:
    """The contexts of depths `first` to `last` of sorted distinct keys that hold all data of their contexts of depth `first`.

    Keys with a count of 0 are only asked for. below (level, nodes' contexts and
    heap places -> logs) and common, of the deepest layer, stand for longer contexts.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, first: int, last: int, common: np.ndarray | None = None, below=None) -> None:
        self.first, self.last = first, last
        self.keys, self.counts, self.up, self.common = {last: keys}, {last: counts}, {}, {last: common}
        self.kept, self.stop, self.logs = {}, {}, []
        for d in range(last, first - 1, -1):
            starts, of = _runs(self.keys[d] >> np.uint64(8))
            self.kept[d] = (np.add.reduceat(self.counts[d], starts) >= LEAST)[of] if d else np.ones(len(of), bool)
            if d > first:
                self.keys[d - 1], up = np.unique(shorter(self.keys[d]), return_inverse=True)
                self.up[d], n = up, len(self.keys[d - 1])
                self.counts[d - 1] = np.bincount(up, self.counts[d], n).astype(np.int64)
                self.common[d - 1] = np.bincount(up, self.counts[d] * ~self.kept[d], n).astype(np.int64)
        for level in range(8):
            logs = nodes = None
            for d in range(last, first - 1, -1):
                starts, of = _runs(self.keys[d] >> np.uint64(8 - level))
                if d < last:
                    own = self.kept[d + 1][nodes]
                    together = np.bincount(of[self.up[d + 1][nodes[own]]], logs[own], len(starts))
                elif below is not None:
                    together = below(level, self.keys[d][starts])
                logs = _log_kt_of(*self._split(self.counts[d], d, level, starts))
                if d < DEPTH:
                    together = together + _log_kt_of(*self._split(self.common[d], d, level, starts))
                    weighted = np.logaddexp(LOG_HALF + logs, LOG_HALF + together)
                    self.stop[d, level] = np.exp(LOG_HALF + logs - weighted).astype(np.float32)
                    logs = weighted
                nodes = starts
            self.logs.append((nodes, logs))  # of the shortest contexts

    def _split(self, counts: np.ndarray, depth: int, level: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bit = (self.keys[depth] >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)
        ones = np.add.reduceat(counts * bit, starts)
        return np.add.reduceat(counts, starts) - ones, ones

    def _chance(self, counts: np.ndarray, depth: int, level: int, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Each key's bit by the KT estimate of its node."""
        zeros, ones = self._split(counts, depth, level, starts)
        bit = (self.keys[depth] >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
        return (np.where(bit, ones[of], zeros[of]) + 0.5) / (zeros + ones + 1)[of]

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the tree above needs, with the place: the shorter keys' counts and common counts, and their nodes' logs."""
        keys, up = np.unique(shorter(self.keys[self.first]), return_inverse=True)
        kept, counts = self.kept[self.first], self.counts[self.first]
        places, one, two = [place_of_key(keys)], [np.bincount(up, counts)], [np.bincount(up, counts * ~kept)]
        for level, (nodes, logs) in enumerate(self.logs):
            own = kept[nodes]
            place, of = np.unique(place_of_node(shorter(self.keys[self.first][nodes]), level), return_inverse=True)
            places.append(place)
            one.append(np.bincount(of, logs * own, len(place)))
            two.append(np.zeros(len(place)))
        return np.concatenate(places), np.concatenate(one), np.concatenate(two)

    def down(self, level: int, fixed: np.ndarray, share: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the deepest keys: their bit's probability is fixed + share * (what longer contexts say), other without any.

        The same three are given for the first layer's keys by what lies above.
        """
        for d in range(self.first, self.last + 1):
            if d > self.first:
                fixed, share, other = (x[self.up[d]] for x in (fixed, share, other))
            starts, of = _runs(self.keys[d] >> np.uint64(8 - level))
            kept, chance = self.kept[d], self._chance(self.counts[d], d, level, starts, of)
            stop = self.stop[d, level][of] if d < DEPTH else 1.0
            fixed, share = np.where(kept, fixed + share * stop * chance, other), np.where(kept, share * (1 - stop), 0.0)
            other = fixed + share * self._chance(self.common[d], d, level, starts, of) if d < DEPTH else fixed
        return fixed, share, other


def place_of_key(keys: np.ndarray) -> np.ndarray:
    """Of keys of depth TOP, beside `place_of_node`."""
    return ((keys >> np.uint64(8) << np.uint64(9)) | np.uint64(256) | (keys & np.uint64(255))).astype(np.int64)


def place_of_node(keys: np.ndarray, level: int) -> np.ndarray:
    heap = np.uint64(1 << level) | (keys & np.uint64(255)) >> np.uint64(8 - level)
    return (keys >> np.uint64(8) << np.uint64(9) | heap).astype(np.int64)


@dataclass
class Top:
    keys: np.ndarray  # of depth TOP, sorted
    parts: np.ndarray  # [8, 3, keys]: `down` of each level


def top(places: np.ndarray, one: np.ndarray, two: np.ndarray) -> Top:
    """The tree of depths 0 to TOP from the `sums` of all that lies below, added up by place and sorted."""
    is_key = (places & 256) > 0
    of_keys = places[is_key]
    keys = (of_keys >> 9 << 8 | of_keys & 255).astype(np.uint64)
    if not len(keys):
        return Top(keys, np.zeros((8, 3, 0), np.float32))
    node_places, node_logs = places[~is_key], one[~is_key]
    tree = Layers(keys, one[is_key].astype(np.int64), 0, TOP, two[is_key].astype(np.int64), lambda level, at: node_logs[np.searchsorted(node_places, place_of_node(at, level))])
    n = len(tree.keys[0])
    return Top(keys, np.array([tree.down(level, np.zeros(n), np.ones(n), np.zeros(n)) for level in range(8)], np.float32))


def pieces(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct keys in runs of about PIECE, each of whole subtrees."""
    starts = np.append(_runs(keys >> np.uint64(8 * (DEPTH - TOP)))[0], len(keys))
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE, "right")) - 1)
        here = slice(starts[i], starts[j])
        yield keys[here], counts[here]
        i = j


def subtree(keys: np.ndarray, counts: np.ndarray) -> Layers:
    return Layers(keys, counts, TOP + 1, DEPTH)


def answers(keys: np.ndarray, counts: np.ndarray, above: Top) -> np.ndarray:
    """log10 probability of each key's byte after its context; keys are whole subtrees."""
    tree = subtree(keys, counts)
    at = np.searchsorted(above.keys, shorter(tree.keys[TOP + 1]))
    total = np.zeros(len(tree.keys[DEPTH]))
    for level in range(8):
        total += np.log10(np.maximum(tree.down(level, *above.parts[level][:, at].astype(float))[0], 1e-9))
    return total.astype(np.float16)


@dataclass
class Level:
    contexts: np.ndarray  # sorted
    parent: np.ndarray  # row in the level above
    by_parent: np.ndarray  # rows in order of parent
    place: np.ndarray  # of each count in [contexts, 256], flat and sorted
    counts: np.ndarray
    common: np.ndarray | None = None  # counts without those of the longer contexts
    stop: np.ndarray | None = None  # [contexts, 255]: weight of the own estimate at each binary node
    one: np.ndarray | None = None  # the own estimate of a one

    def dense(self, counts: np.ndarray, start: int, end: int) -> np.ndarray:
        """[end - start, 256] of the level's sparse counts."""
        i, j = np.searchsorted(self.place, [start * 256, end * 256])
        out = np.zeros((end - start) * 256)
        out[self.place[i:j] - start * 256] = counts[i:j]
        return out.reshape(-1, 256)

    def parts(self) -> list[tuple[int, int]]:
        n = len(self.contexts)
        return [(i, min(i + PART, n)) for i in range(0, n, PART)]


class Tree:
    """child[node, byte]: the node after one more byte back, or a leaf as -1 - leaf; table[leaf, byte]: log10 probability.

    It travels compressed and is unpacked when first used.
    """

    def __init__(self, child: np.ndarray, table: np.ndarray) -> None:
        self.child, self.table = child, table

    def __getstate__(self) -> tuple:
        pack = zstandard.ZstdCompressor(level=1).compress
        return pack(self.child.view(np.uint8).reshape(-1, 4).T.tobytes()), pack(self.table.view(np.uint8).reshape(-1, 2).T.tobytes())

    def __setstate__(self, state: tuple) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        child, table = (np.frombuffer(unpack(s), np.uint8) for s in state)
        self.child = np.ascontiguousarray(child.reshape(4, -1).T).view(np.int32).reshape(-1, 256)
        self.table = np.ascontiguousarray(table.reshape(2, -1).T).view(np.float16).reshape(-1, 256)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability, its end included."""
        if not texts:
            return np.zeros(0)
        data, starts = streams(texts)
        wide = data.astype(np.int64)
        n = len(data) - DEPTH
        state = self.child[0][wide[DEPTH - 1 : DEPTH - 1 + n]]
        for back in range(2, DEPTH + 1):
            inner = np.flatnonzero(state >= 0)
            state[inner] = self.child[state[inner], wide[inner + DEPTH - back]]
        bits = self.table[-1 - state, wide[DEPTH:]].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(bits)])
        ends = np.append(starts[1:] - DEPTH, len(data)) - DEPTH
        return total[ends] - total[starts - DEPTH]


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The tree from counted (context, next byte) of each depth 0 to DEPTH, as `frequent` gives them.

    Every context's shorter contexts are there too; without any data, all bytes are equally likely.
    """
    made: list[Level] = []
    for depth, (keys, counts) in enumerate(levels):
        if depth == 0 and not len(keys):
            keys, counts = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        contexts, row = np.unique(keys >> np.uint64(8), return_inverse=True)
        parent = np.zeros(len(contexts), np.int64)
        if depth:
            shorter = np.uint64((1 << 8 * (depth - 1)) - 1)
            parent = np.searchsorted(made[-1].contexts, contexts & shorter)
            made[-1].common = made[-1].counts.copy()
            of = np.searchsorted(made[-1].place, parent[row] << 8 | (keys & np.uint64(255)).astype(np.int64))
            np.subtract.at(made[-1].common, of, counts)
        made.append(Level(contexts, parent, np.argsort(parent, kind="stable"), row * 256 + (keys & np.uint64(255)).astype(np.int64), counts))
    last = len(made) - 1
    below = np.zeros((0, 255))
    for depth in range(last, -1, -1):
        level = made[depth]
        n = len(level.contexts)
        weighted = np.empty((n, 255))
        if depth < last:
            longer = made[depth + 1]
            level.stop, level.one = np.empty((n, 255), np.float32), np.empty((n, 255), np.float32)
        for i, j in level.parts():
            zeros, ones = _zeros_ones(level.dense(level.counts, i, j))
            own = _log_kt(zeros, ones)
            if depth == last:
                weighted[i:j] = own
                continue
            together = _log_kt(*_zeros_ones(level.dense(level.common, i, j)))
            a, b = np.searchsorted(longer.parent[longer.by_parent], [i, j])
            children = longer.by_parent[a:b]
            np.add.at(together, longer.parent[children] - i, below[children])
            weighted[i:j] = np.logaddexp(LOG_HALF + own, LOG_HALF + together)
            level.stop[i:j] = np.exp(LOG_HALF + own - weighted[i:j])
            level.one[i:j] = (ones + 0.5) / (zeros + ones + 1)
        below = weighted
    del below, weighted
    first_node = np.cumsum([0, *(len(x.contexts) for x in made[:-1])])
    child = np.zeros((first_node[last], 256), np.int32)
    tables, n_leaves = [], 0
    for depth in range(last):  # the common branch of every context
        level, rows = made[depth], len(made[depth].contexts)
        child[first_node[depth] : first_node[depth] + rows] = (-1 - (n_leaves + np.arange(rows)))[:, None]
        tables += [_predictions(made, depth, np.arange(i, j), level.dense(level.common, i, j)) for i, j in level.parts()]
        n_leaves += rows
    for depth in range(1, last + 1):
        rows = len(made[depth].contexts)
        byte = (made[depth].contexts >> np.uint64(8 * (depth - 1))).astype(np.int64)
        child[first_node[depth - 1] + made[depth].parent, byte] = first_node[depth] + np.arange(rows) if depth < last else -1 - (n_leaves + np.arange(rows))
    level = made[last]
    tables += [_predictions(made, last - 1, level.parent[i:j], level.dense(level.counts, i, j)) for i, j in level.parts()]
    return Tree(child, np.concatenate(tables))


def _predictions(made: list[Level], depth: int, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes at leaves with these counts below rows of a level."""
    zeros, ones = _zeros_ones(counts)
    one = (ones + 0.5) / (zeros + ones + 1)
    while depth >= 0:
        level = made[depth]
        stop = level.stop[row]
        one = stop * level.one[row] + (1 - stop) * one
        row, depth = level.parent[row], depth - 1
    one = np.clip(one.astype(np.float64), 1e-9, 1 - 1e-9)
    log_one, log_zero = np.log10(one), np.log10(1 - one)
    total = np.zeros((len(counts), 2))[:, :1]
    for level in range(8):
        first = (1 << level) - 1
        here = slice(first, 2 * first + 1)
        total = np.stack([total + log_zero[:, here], total + log_one[:, here]], axis=2).reshape(len(counts), -1)
    return total.astype(np.float16)
