"""Brute-force versions that several tests share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def brute_components(rows, n, num, den):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def brute_windows(rows, n):
    """Texts after removing repeated windows; documents that lose all words are left out."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def brute_leaks(rows, items, similarity):
    def tokens(t):
        return CLEAN.findall("".join(c.lower() if c.isascii() else c for c in t or ""))

    def nearest(item, doc):
        row = [0] * (len(doc) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(doc, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    known = [tokens(t) for _, t in items]
    return {i for i, t in rows if any(it and nearest(it, tokens(t)) <= int((1 - similarity) * len(it) + 1e-9) for it in known)}
