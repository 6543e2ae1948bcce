"""Plain restatements of the operators for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def kept_words(rows, width=13):
    """``(n_words, n_removed, kept)`` of every ``(id, text)``."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - width + 1):
                window = tuple(words[k:k + width])
                least[window] = min(least.get(window, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        if i is not None:
            for k in range(len(words) - width + 1):
                if least[tuple(words[k:k + width])] < i:
                    gone[k:k + width] = [True] * width
        out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return out


def shingles(text, width=5):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def near_components(rows, width=5, percent=75):
    """``(n_shingles, component)`` of every ``(id, text)``; rows are vertices."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for token in s:
            holders[token].append(k)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for token in s:
            for other in holders[token]:
                if other > k:
                    common[other] += 1
        for other, n in common.items():
            if rows[k][0] is not None and rows[other][0] is not None and 100 * n >= percent * (len(s) + len(sets[other]) - n):
                parent[root(other)] = root(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(len(sets[k]), None if i is None else least[root(k)]) for k, (i, _) in enumerate(rows)]


def edit_distance_inside(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
