"""Clusters against plain Lloyd in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from trajloom.llm import cluster


def lloyd(rows, k, rounds, dims, scale, seed):
    """rows: (id, vector). Everything anew in every round."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(kept, key=rank)[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((apart(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == n]:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = {}
    for _, n, d in found:
        per[n] = per.get(n, 0) + d
    sha = lambda n: hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()
    return sorted((str(i), n, d, per[n], sum(per.values()), sha(n)) for i, n, d in found)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, __points string").repartition(3)
    trace = cluster.Trace()
    got = cluster.delta_lloyd(df, trace=trace, **settings)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r["vec_id"]), *r[1:]) for r in got.collect()), trace


def test_as_plain_lloyd(spark):
    rng = random.Random(7)
    settings = {"k": 6, "rounds": 5, "dims": 3, "scale": 16, "seed": 2}
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(30)]  # ties and equal vectors
    rows += [(7, [5.0, 5.0, 5.0]), (7, [5.0, 5.0, 5.0]), (7, [-1.0, 2.0, 0.0]), (None, [0.5, 0.5, 0.5])]  # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 2.0]), (2004, [math.nan, 0.0, 0.0]), (2005, [math.inf, 0.0, 0.0]), (2006, [1.0] * 4)]
    got, trace = run(spark, rows, **settings)
    assert got == lloyd(rows, **settings)
    assert len(trace.changed) == 5 and trace.changed[0] > 0


def test_fewer_vectors_than_centroids_and_none(spark):
    settings = {"k": 5, "rounds": 3, "dims": 2, "scale": 256, "seed": 2}
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [-0.7, 0.0])]
    got, trace = run(spark, rows, **settings)
    assert got == lloyd(rows, **settings) and len(trace.changed) < 3  # nothing changed any more: no further rounds
    assert run(spark, [(1, [1.0])], **settings)[0] == [] and run(spark, [], **settings)[0] == []


def test_large_components_fail_and_distances_are_exact(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e30, 0.0])], k=1, rounds=1, dims=2, scale=256, seed=2)
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(1 << 28), 1 << 28, (50, 8)), rng.integers(-(1 << 28), 1 << 28, (7, 8))
    assert cluster.distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]


def test_comparing_with_changed_centroids_only(spark):
    rng = np.random.default_rng(3)
    x, c = rng.integers(-9, 9, (500, 2)), rng.integers(-9, 9, (12, 2))
    owner, distance = cluster.nearest(x, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(12, bool))
    for _ in range(20):
        changed = rng.random(12) < 0.3
        c = np.where(changed[:, None], rng.integers(-9, 9, (12, 2)), c)
        owner, distance = cluster.nearest(x, owner, distance, c, changed)
        d = cluster.distances(x, c)
        assert (owner == d.argmin(1)).all() and (distance == d.min(1)).all()
