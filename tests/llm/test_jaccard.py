import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import jaccard
from cohortlab.llm.components import components
from tests.llm.helpers import DOCS, brute_components, clashing, shingle_set


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, groups, copies, length):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(1, length))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
                words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 50)}"
            if rnd.random() < 0.2:
                words = words[:max(1, len(words) - rnd.randint(0, 5))]
            rows.append(" ".join(words))
    ids = rnd.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 85)])
def test_components_equal_brute_force(spark, size, percent):
    rows = near_copies(size, 40, 12, 160)
    got = found(jaccard.similar(spark.createDataFrame(rows, DOCS), size, percent))
    assert got == brute_components(rows, size, percent)


def test_large_group_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rows = near_copies(5, 2, 150, 90)
    got = found(jaccard.similar(spark.createDataFrame(rows, DOCS), 3, 90))
    assert got == brute_components(rows, 3, 90)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, "a b c"), (None, "z y x w"), (7, "x " * 30_000), (8, "X " * 40_000), (6, "a b c"), (9, "only one here")]
    df = clashing(spark, rows)
    got = [tuple(r) for r in jaccard.similar(df, 3, 90).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, 6), (None, 2, None), (7, 1, 7), (8, 1, 7), (6, 1, 6), (9, 1, 9)], key=str)
    kept = jaccard.one_of_each(df, 3, 90)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 0)] + [(True, x) for x in (1, 2, 3, 4, 6, 7, 9)]
    empty = df.where("doc_id < 0")
    assert jaccard.similar(empty, 3, 90).collect() == [] and jaccard.one_of_each(empty).collect() == []


def test_same_id_twice(spark):
    """Rows with one id are one document: either text links it."""
    base = [f"t{i}" for i in range(60)]
    other = [f"u{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (3, " ".join(base + ["q"])), (9, " ".join(other + ["q"]))]
    got = sorted(tuple(r) for r in jaccard.similar(spark.createDataFrame(rows, DOCS), 3, 90).collect())
    assert [c for _, _, c in got] == [3, 3, 3, 3]


def test_same_id_ties_its_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    found = jaccard.similar(spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (8, c), (1, c), (8, a + " more"), (7, "x y z"), (7, "x y z")], DOCS), 3, 80).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert len(found) == 9 and got == {5: 1, 3: 1, 9: 1, 8: 1, 1: 1, 7: 7}
    apart = jaccard.similar(spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (9, b)], DOCS), 3, 80).collect()
    assert {r["component_id"] for r in apart} == {3}


def test_extreme_ids(spark):
    text = " ".join(f"t{i}" for i in range(80))
    rows = [(2**62 + 1, text), (2**62, text + " x"), (-2**62 - 3, text + " y")]
    assert {c for _, c in found(jaccard.similar(spark.createDataFrame(rows, DOCS), 3, 90)).values()} == {-2**62 - 3}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 2**31), st.sampled_from([60, 80, 90, 95]))
def test_linked_sets_share_a_key(n, edits, seed, percent):
    """Pigeonhole: sets within the allowed difference always have a key in common, and sketches bound it."""
    rnd = np.random.default_rng(seed)
    a = np.unique(rnd.integers(0, 2**64, n, np.uint64))
    b = np.unique(np.r_[a[min(len(a) - 1, edits // 2):], rnd.integers(0, 2**64, edits - edits // 2, np.uint64)])
    both = len(np.intersect1d(a, b))
    apart = len(a) + len(b) - 2 * both
    bands = jaccard.Bands(percent)
    for c, blocks, _ in bands.of(len(a)):
        pa, pb = jaccard.sketch(a, blocks)[0], jaccard.sketch(b, blocks)[0]
        assert np.bitwise_count(pa ^ pb).sum() <= apart
        assert np.bitwise_count(jaccard.folded(pa) ^ jaccard.folded(pb)).sum() <= apart
    if apart and 100 * both >= percent * (len(a) + len(b) - both):
        assert set(jaccard.block_keys(a, bands)) & set(jaccard.block_keys(b, bands))


def test_shingles_are_those_of_the_words():
    s = jaccard.Shingles(3)
    for text in ("", "a", "a b", "a b c", "a b c a b c a b c", "Ä b\x0bc\x1cd  e", "x " * 500):
        assert len(s(text.encode())) == len(shingle_set(text, 3))
    assert len(s(None)) == 0


def test_components_of_links(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
