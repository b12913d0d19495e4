"""Brute-force versions of what the operators do, on plain Python values."""

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def bag(text, size=5):
    w = words(text)
    return Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def near_classes(rows, threshold=0.8):
    """Class of each id: connected components over all pairs."""
    ids = [i for i, t in rows if i is not None and t is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    whole = [(i, t, bag(t)) for i, t in rows if i is not None and t is not None]
    for n, (i, t, b) in enumerate(whole):
        for j, u, c in whole[:n]:
            less, more = sorted((sum(b.values()), sum(c.values())))
            if t == u or (less >= threshold * more - 1e-6 and b and c and jaccard(b, c) >= threshold - 1e-9):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(rows, size=13):
    """Kept words of each row by the plain definition of the removal."""
    last = 1 << 63
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, last), last - 1 if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (last - 1 if i is None else i):
                gone[k:k + size] = [True] * size
        out.append((i, t, len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def prose(seed, n, vocabulary=4000):
    """Words of a fixed pseudo-random sequence."""
    out, x = [], seed * 2654435761 % (1 << 32) + 1
    for _ in range(n):
        x = (1103515245 * x + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % vocabulary}")
    return out


def variants(n):
    """Variants of a text at 15 places, few of them alike, so that buckets hold hundreds of components; and their classes.

    Each place is in five shingles of its own, so two are alike if they differ at three places or fewer.
    """
    base, kind = prose(5, 150), np.random.default_rng(1).integers(0, 3, (n, 15))
    rows, classes = [], list(range(n))
    for i in range(n):
        words = list(base)
        words[5::10] = [f"v{k}" for k in kind[i]]
        rows.append((i, " ".join(words)))
        for j in np.flatnonzero((kind[:i] != kind[i]).sum(1) <= 3):
            one, two = classes[i], classes[j]
            classes = [min(one, two) if w in (one, two) else w for w in classes]
    return rows, classes
