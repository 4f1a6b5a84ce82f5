"""Plain versions of the operators, for comparison."""

import collections
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, span=13):
    """doc index -> (words, hit words, item ids)"""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = LETTERS.findall((t or "").translate(LOW))
        if 0 < len(w) < span:
            windows[tuple(w)].add(str(i))
        for k in range(len(w) - span + 1):
            windows[tuple(w[k : k + span])].add(str(i))
    out = []
    for t in docs:
        w, hit, found = LETTERS.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def shingles(text, n=3):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(docs, n=3, percent=90):
    """doc id -> (set size, smallest id that links lead to), over all pairs"""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def base(text):
    w = SPACED.findall(text or "")
    n = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)
