"""Brute-force versions of the operators, for small tables."""

import hashlib
import itertools
import re

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall((text or "").encode())


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def groups(nodes, links):
    """node -> smallest node reachable."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = [lower(x) for x in words(text)]
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1))


def near_duplicates(texts, width=4, percent=80):
    """{doc_id: text} -> {doc_id: (set size, component, kept)}"""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            links.append((a, b))
    root = groups(sets, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def without_repeats(texts, width=50):
    """{doc_id: text} -> {doc_id: kept words, number removed}"""
    first, out = {}, {}
    for i in sorted(texts):
        for k in range(len(w := words(texts[i])) - width + 1):
            first.setdefault(tuple(w[k:k + width]), i)
    for i, t in texts.items():
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = ([x for k, x in enumerate(w) if k not in gone], len(gone))
    return out


def sha(kept):
    return hashlib.sha256(b" ".join(kept)).hexdigest()
