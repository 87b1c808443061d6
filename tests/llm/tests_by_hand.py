"""Brute-force versions that several tests share."""

import re

from caselattice.llm import text_kernel


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def classes_by_hand(rows):
    words = [text_kernel.word_hashes((t or "").encode()).tolist() for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            most = max(len(words[i]), len(words[j]))
            if words[i] == words[j] or (most * 4 // 5 <= min(len(words[i]), len(words[j])) and 5 * distance(words[i], words[j]) <= most):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def shingles(t, size):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    n = min(size, len(w))
    return n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def leaks_by_hand(text, items):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    out = {}
    for item, t in items:
        n, s = shingles(t, 5)
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if s and len(s & own) >= 0.8 * len(s) - 1e-9:
            out[item] = max(out.get(item, 0), len(s & own) / len(s))
    return sorted(out.items())
