"""Plain restatements of what the corpus operators promise."""

import hashlib
import re

SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = words(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(rows, size, percent):
    """doc_id -> least doc_id that links lead to."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, set()).add(shingles(t, size))
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: top(d) for d in sets}


def without_repeats(rows, window):
    """[(doc_id, kept words, removed)] with windows judged on the input."""
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            owner[k] = min(d, owner.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, [x for i, x in enumerate(w) if i not in gone], len(gone)))
    return out


def sub_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        nxt = [i + 1]
        for j, b in enumerate(text):
            nxt.append(min(row[j + 1] + 1, nxt[j] + 1, row[j] + (a != b)))
        row = nxt
    return min(row)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
