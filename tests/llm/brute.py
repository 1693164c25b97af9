"""Plain versions of the contracts, one document at a time."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def components(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_links(sets, percent=75):
    places = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            places[x].append(d)
    common = Counter()
    for ds in places.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                common[tuple(sorted((a, b)))] += 1
    return [p for p, n in common.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def windows(items, size=10):
    found = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text, ALNUM)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if k else ():
            found[k][tuple(w[i: i + k])].add(str(item))
    return found


def hits(text, found):
    w, at, items = words(text, ALNUM), set(), set()
    for k, known in found.items():
        for i in range(len(w) - k + 1):
            here = known.get(tuple(w[i: i + k]))
            if here:
                at.update(range(i, i + k))
                items |= here
    return len(w), at, sorted(items)


def repeats(texts, size):
    """texts: {id: text}. For each: number of words, repeated words, words outside the first occurrence of a passage."""
    count, first, split = Counter(), {}, {d: words(t) for d, t in texts.items()}
    for d in sorted(split):
        for i in range(len(split[d]) - size + 1):
            run = tuple(split[d][i: i + size])
            count[run] += 1
            first.setdefault(run, (d, i))
    out = {}
    for d, w in split.items():
        every, extra = set(), set()
        for i in range(len(w) - size + 1):
            run = tuple(w[i: i + size])
            if count[run] > 1:
                every.update(range(i, i + size))
                if first[run] != (d, i):
                    extra.update(range(i, i + size))
        out[d] = (len(w), every, extra)
    return out
