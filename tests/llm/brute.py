"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK = b" \t\n\x0b\x0c\r"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def raw(text):
    return (text or "").encode()


def line_dedup(docs, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).lower()
    for i, t in docs:
        for line in raw(t).split(b"\n"):
            if i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = raw(t).split(b"\n")
        keep = [x for x in lines if not (len(key(x).decode()) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), sha(b"\n".join(keep))))
    return out


def words(b):
    return bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in b).split()


def decontaminate(docs, items, width=10):
    windows = defaultdict(set)
    for item, t in items:
        w = words(raw(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("null" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, found = words(raw(t)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def statistics(text):
    b = raw(text)
    w = b.split()
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in b.split(b"\n") if x.strip(BLANK)]
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(b.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), len(lines) - len(set(lines)), len(hit)


def near(docs, n, percent=80):
    sets = []
    for _, t in docs:
        w = raw(t).lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(inverted[x])
            inverted[x].append(k)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known, default=None)
    return [(i, len(sets[k]), i if not sets[k] else least[find(k)]) for k, (i, _) in enumerate(docs)]


def repeats(docs, width=200):
    n = Counter()
    for _, t in docs:
        b = raw(t)
        n.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for i, t in docs:
        b = raw(t)
        edge = np.zeros(len(b) + 1, int)
        for j in range(len(b) - width + 1):
            if n[b[j : j + width]] > 1:
                edge[j] += 1
                edge[j + width] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def base_scores(docs):
    """doc_id -> (n_tokens, n_known, train_tokens, base)."""
    tokens = lambda t: [*raw(t).lower().split(), None]
    c = Counter()
    for i, t in docs:
        if crc(i) % 5 != 1:
            c.update(tokens(t))
    total, distinct = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        w = tokens(t)
        out[i] = (len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
    return out


def margin(trees, text):
    """Log-odds of bad quality by a walk from each root, over plainly counted features."""
    n, chars, symbols, dup, repeated = statistics(text)
    b = raw(text)
    lines = sum(bool(x.strip(BLANK)) for x in b.split(b"\n"))
    some, letters, rows = max(n, 1), max(chars, 1), max(lines, 1)
    of = lambda chosen: sum(c in chosen for c in b)
    x = [np.log1p(n), chars / some, symbols / some, dup / rows, repeated / some, len(set(b.split())) / some]
    x += [of(range(65, 91)) / letters, of(b"0123456789") / letters, of(b"!") / some, of(b".,") / some, n / rows]
    total = trees.start
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        total += value[at - len(feature)]
    return total
