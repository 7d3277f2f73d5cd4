import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trajloom.llm import jaccard


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Components and links by comparing all pairs that share a shingle."""
    sets, of, parent = [shingle_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            of[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in of[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), k if not sets[i] else least.get(find(i))) for i, (k, _) in enumerate(rows)]


def checked(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string").repartition(3)
    out, _ = jaccard.similar_documents(df)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 8, 9, 12, 20, 60, 200, 700]))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            t = t + passage
        rows.append((i, " ".join(t).upper() if rng.random() < 0.1 else " ".join(t)))
    return rows


def test_components_by_brute_force(spark):
    checked(spark, corpus(1, 300, 500))


def test_common_vocabulary_and_large_groups(spark):
    rng = random.Random(5)
    original = [f"t{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"x{rng.random()}" for w in original)) for i in range(150)]
    checked(spark, rows + corpus(2, 120, 6))


def test_tiles(spark, monkeypatch):
    """Blocks compared in several tiles find the same components."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = random.Random(6)
    original = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.005, 0.02, 0.05]) else f"x{rng.random()}" for w in original)) for i in range(120)]
    checked(spark, rows + corpus(3, 60, 40))


def test_every_link_by_brute_force(spark, monkeypatch):
    """A group of near copies has all its links, in small blocks and in tiles; repeats of a text add none."""
    monkeypatch.setattr(jaccard, "SMALL", 16)
    monkeypatch.setattr(jaccard, "TILE", 16)
    same = " ".join(f"t{i}" for i in range(90))
    rows = [(i, f"{same} end{i}") for i in range(40)] + [(100, f"{same} end0"), (101, "a lonely text of six words"), (102, ""), (None, f"{same} end99")] + [(200 + i, t) for i, t in corpus(8, 90, 60)]
    sets = {k: s for k, s in ((t, shingle_set(t)) for _, t in rows)}
    different = sorted(set(sets.values()) - {frozenset()}, key=sorted)
    alike = lambda a, b: a != b and 100 * len(a & b) >= 80 * len(a | b)
    degree = {a: sum(alike(a, b) for b in different) for a in different} | {frozenset(): 0}
    out, links = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every_link=True)
    assert links.count() == links.distinct().count() == sum(degree.values()) // 2 >= 41 * 40 // 2
    assert sorted(((r["doc_id"], r["n_links"]) for r in out.collect()), key=str) == sorted(((k, degree[sets[t]]) for k, t in rows), key=str)


def test_nulls_ties_and_repeats(spark):
    a, b, c = "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n o", "b c d e f g h i j k l m n o p"
    checked(spark, [(None, b), (4, a), (9, c), (4, a), (7, None), (8, ""), (3, " \t"), (5, "one two"), (6, "ONE two"), (None, "lonely text of six words here"), (None, "x")])
    out, links = jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and links.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10_000), st.floats(0, 1))
def test_similar_sets_share_a_key(n, seed, common):
    """Whatever shingles count as frequent: two sets at the threshold share a key."""
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    n, bands = len(h), jaccard.Bands(80)
    drop = rng.integers(0, n // 5 + 1)
    other = np.sort(np.concatenate([h[drop:], np.unique(rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), dtype=np.uint64) * np.uint64(2))]))
    both = len(np.intersect1d(h, other))
    if 100 * both < 80 * (n + len(other) - both) or both == n == len(other):
        return
    every = np.unique(np.concatenate([h, other]))
    frequent = every[rng.random(len(every)) < common]
    place = rng.permutation(len(frequent))
    keys = [jaccard.block_keys(x, jaccard.ranks(x, frequent, place), bands) for x in (h, other)]
    assert len(np.intersect1d(*keys))
    words = jaccard.sketch_words(max(n, len(other)))
    apart = np.bitwise_count((jaccard.parity_bits(h, words) ^ jaccard.parity_bits(other, words)).view(np.uint64)).sum()
    assert apart <= n + len(other) - 2 * both


def test_components_of_paths_and_stars(spark):
    from trajloom.llm.common import Tables

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 500), (500, 900)]
    got = {r["v"]: r["label"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    assert set(got) == {x for e in edges for x in e}
    assert all(label == (100 if 100 <= v < 500 else 0) for v, label in got.items())
