"""Plain single-machine versions that the operators are compared with."""

import collections
import math
import re

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern):
    return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(found, width):
    if not found:
        return []
    if len(found) < width:
        return [tuple(found)]
    return [tuple(found[i : i + width]) for i in range(len(found) - width + 1)]


def near_duplicates(rows, width):
    """doc_id -> (size of its set, smallest doc_id reachable), from all pairs that share a shingle."""
    sets = {d: frozenset(shingles(words(t, SPACED), width)) for d, t in rows}
    held = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, own in sets.items():
        shared = collections.Counter(b for x in own for b in held[x] if b > a)
        for b, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def contaminated(docs, items):
    """(doc_id, item_id) -> (windows near the item, best similarity), over all windows."""
    out = {}
    widths = [(i, words(t, PLAIN)) for i, t in items]
    bags = [(i, min(5, len(w)), collections.Counter(shingles(w, 5))) for i, w in widths]
    for d, text in docs:
        found = words(text, PLAIN)
        runs = {k: shingles(found, k) if len(found) >= k else [] for k in range(6)}
        for i, width, bag in bags:
            run, size = runs[width], sum(bag.values())
            span = min(size, len(run))
            if not size or not span or not set(run) & set(bag):
                continue
            near, best = 0, 0.0
            for p in range(len(run) - span + 1):
                n = sum((collections.Counter(run[p : p + span]) & bag).values())
                if 100 * n >= 80 * (size + span - n):
                    near, best = near + 1, max(best, n / (size + span - n))
            if near:
                out[d, i] = near, best
    return out


def nearest(rows, k=5):
    """(query, rank, vec_id, cosine) of the rows whose id is divisible by 50, over all other rows."""
    sound = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        sound[i] = min(sound.get(i, v), v)
    if not sound:
        return []
    size = len(sound[min(sound)])
    ids = sorted(i for i, v in sound.items() if len(v) == size)
    data = np.array([sound[i] for i in ids], float)
    norms = np.sqrt((data * data).sum(axis=1))
    out = []
    for n, query in enumerate(ids):
        if query % 50 == 0:
            scores = (data * data[n]).sum(axis=1) / (norms * norms[n])
            best = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != query)[:k]
            out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out
