"""Centroid clustering against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters, rounds, dimensions, scale=1024):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in e]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), cents


def rows_of(found):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.vectors.collect()), key=str)


def test_against_plain_rounds_with_edges(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (None, [0.5] * 6), (7, [0.25] * 6), (7, [0.25] * 6)]
    rows += [(300 + i, [2.0] * 6) for i in range(60)]  # one vector that repeats
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).withColumns({c: F.lit(1) for c in ("v", "cluster", "upper", "lower", "was", "distance", "x")})
    for dealt in (df.repartition(3), df.coalesce(1)):
        found = C.cluster_vectors(dealt, clusters=8, rounds=10, dimensions=6)
        want, cents = plain(rows, 8, 10, 6)
        assert rows_of(found) == want and found.centroids.tolist() == cents
        assert found.inertia == [sum(d for _, j, d in want if j == k) for k in range(8)]


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64, 0), (2, [1.0] * 64, 0), (3, [2.0] * 64, 0)], SCHEMA)
    found = C.cluster_vectors(df)
    want, cents = plain([(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)], 8, 10, 64)
    assert rows_of(found) == want and found.centroids.tolist() == cents
    assert C.cluster_vectors(df.limit(0)) is None
    assert C.cluster_vectors(df.where("vec_id = 3")).inertia == [0]


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-100_000, 100_000, 64)]) for i in range(40)]
    found = C.cluster_vectors(spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA))
    assert rows_of(found) == plain(rows, 8, 10, 64)[0]
    with pytest.raises(PySparkException, match="larger"):
        C.cluster_vectors(spark.createDataFrame([(1, [1e6] * 64, 0)], SCHEMA))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(1, 30), st.sampled_from([3, 50, 5_000_000]))
def test_bounds_never_change_a_result_and_spare_scans(seed, k, n, size):
    rng = np.random.default_rng(seed)
    x, cents = rng.integers(-size, size, (n, 3)), rng.integers(-size, size, (k, 3))
    state, before = (np.full(n, -1), np.zeros(n), np.zeros(n)), cents
    for _ in range(6):
        at = C.Geometry.of(cents, before)
        *state, scanned = C.reassign(x, *state, at)
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in cents] for v in x])
        assert (state[0] == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(n), state[0]])
        assert (state[1] >= own).all()
        d[np.arange(n), state[0]] = np.iinfo(np.int64).max
        assert k == 1 or (state[2] <= np.sqrt(d.min(1).astype(float))).all()
        before, cents = cents, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else cents[j] for j in range(k)])
    assert C.reassign(x, *state, C.Geometry.of(before, before))[3] <= scanned + n


def test_settled_clusters_are_not_scanned():
    rng = np.random.default_rng(1)
    cents = np.array([[0, 0], [1000, 1000]])
    x = np.concatenate([rng.integers(-50, 50, (500, 2)), rng.integers(950, 1050, (500, 2))])
    at = C.Geometry.of(cents, cents)
    *state, scanned = C.reassign(x, np.full(1000, -1), np.zeros(1000), np.zeros(1000), at)
    assert scanned == 1000
    assert C.reassign(x, *state, C.Geometry.of(cents + 3, cents))[3] == 0
