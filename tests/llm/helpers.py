"""Frames and brute-force versions for the tests of the text operators."""

from collections import defaultdict

DOCS = "doc_id long, text string"
#: Extra columns with names that the operators use inside.
CLASH = "doc_id long, text string, key string, id string, n long, fp binary, x int, words string, comp int, salt string, grp int"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, "k", "i", 1, b"f", 2, "w", 3, "s", 4) for d, t in rows], CLASH)


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size, percent):
    """(shingles, smallest id reachable) by id, all pairs compared; ids are unique."""
    sets = {d: shingle_set(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inverted[g].append(d)
    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in inverted[g]:
                if e < d:
                    shared[e] += 1
        for e, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}
