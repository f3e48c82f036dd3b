"""Centroid clustering of integer vectors: Lloyd's rounds with Hamerly's bounds, exact to the last digit.

Components are scaled and floored to integers, and every distance that decides is computed in
integers, so results do not depend on how rows are dealt over tasks. Each vector carries one upper
bound on the distance to its own centroid and one lower bound on that to the second nearest. When
centroids move the bounds are loosened by their drift. A vector whose upper bound is strictly below
its lower one, or below half the gap between its centroid and the next, can't change and isn't
looked at. Of the rest the own distance is worked out, and those still in doubt are scanned in full.

Vectors and bounds are written once a round; sums of clusters follow from the vectors that moved.
The driver holds the centroids and their sums alone. No vector is shuffled.

Rows with a null array, another number of components, or one that is null, NaN or infinite are left
out. Rows that repeat count as often as they occur. A null vec_id comes last in the choice of
first centroids; ties there are settled by the vectors. With fewer vectors than clusters there are
as many clusters as vectors; an empty table gives no rows. Components of LIMIT or more in size are
an error, as a squared distance would no longer fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, scratch

DIMENSIONS, CLUSTERS, ROUNDS = 64, 8, 10
SCALE, SEED = 1024, 3
#: Largest scaled component: 64 squared differences of twice that fit a long.
LIMIT = 1 << 27
#: Scaled components below which sums of 64 products are whole numbers in a double.
EXACT = 1 << 22
#: What rounding may add to a bound, as a share.
SLACK = 1e-9


@dataclass
class Clusters:
    """vectors (vec_id, cluster, distance) and each cluster's final centroid and sum of distances."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: list[int] = field(default_factory=list)


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the scaled and floored components of the rows that have all of them."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")).where((F.size("x") == dimensions) & F.forall("x", finite))
    fits = F.forall("x", lambda x: F.abs(x) < LIMIT / scale)
    v = F.transform("x", lambda x: F.floor(x * scale).cast("int"))
    return whole.select("vec_id", F.when(fits, v).otherwise(F.raise_error(F.lit(f"a component is {LIMIT // scale} or larger"))).alias("v"))


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose seeded hash of the vec_id is least, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        out[:, j] = ((x - c[j]) ** 2).sum(1)
    return out


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - c[cluster]) ** 2).sum(1)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


@dataclass
class Geometry:
    """What a round knows of its centroids: how far each moved, the most that any other one moved, and half the gap to the next."""

    centroids: np.ndarray
    drift: np.ndarray
    others: np.ndarray
    half_gap: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray) -> "Geometry":
        k = len(centroids)
        drift = up(np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)))
        others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(k)])
        apart = squared(centroids, centroids).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        return cls(centroids, drift, others, down(np.sqrt(apart.min(1)) / 2))


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds against new centroids, and how many vectors were scanned in full; cluster is -1 where there is none yet."""
    cluster, known = cluster.copy(), cluster >= 0
    upper = np.where(known, up(upper + at.drift[cluster]), np.inf)
    lower = np.where(known, np.maximum(0.0, down(lower) - up(at.others[cluster])), 0.0)
    least = np.where(known, np.maximum(lower, at.half_gap[cluster]), 0.0)
    doubt = np.flatnonzero(~(upper < least))
    seen = doubt[known[doubt]]
    upper[seen] = up(np.sqrt(own_squared(x[seen], at.centroids, cluster[seen]).astype(np.float64)))
    doubt = doubt[~(upper[doubt] < least[doubt])]
    if len(doubt):
        d = squared(x[doubt], at.centroids)
        nearest = d.argmin(1)  # the first of equals
        rows = np.arange(len(doubt))
        cluster[doubt], upper[doubt] = nearest, up(np.sqrt(d[rows, nearest].astype(np.float64)))
        d[rows, nearest] = np.iinfo(np.int64).max
        lower[doubt] = down(np.sqrt(d.min(1).astype(np.float64))) if len(at.centroids) > 1 else np.inf
    return cluster, upper, lower, len(doubt)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def assigned(state: DataFrame, at: Geometry, last: bool) -> DataFrame:
    """state with clusters and bounds against new centroids and the clusters before (was); the last time distances instead."""
    fresh = "cluster" not in state.columns
    id_type = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, none = _vectors(b), np.zeros(b.num_rows)
            was = np.full(b.num_rows, -1) if fresh else b.column("cluster").to_numpy().astype(np.int64)
            upper, lower = (none, none) if fresh else (b.column("upper").to_numpy(), b.column("lower").to_numpy())
            cluster, upper, lower, _ = reassign(x, was, upper, lower, at)
            own = {"vec_id": b.column("vec_id"), "cluster": cluster.astype(np.int32)}
            if last:
                own["distance"] = own_squared(x, at.centroids, cluster)
            else:
                own |= {"v": b.column("v"), "upper": upper, "lower": lower, "was": was.astype(np.int32)}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in own.items()})

    return state.mapInArrow(run, f"vec_id {id_type}, cluster int, " + ("distance long" if last else "v array<int>, upper double, lower double, was int"))


def add_moves(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Brings sums and counts up to date by the vectors whose cluster changed: added to the new one, taken from the one before."""
    moves = F.filter(F.array(F.struct(F.col("cluster").alias("j"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("j"), F.lit(-1).alias("sign"))), lambda m: m["j"] >= 0)
    moved = state.where(F.col("cluster") != F.col("was")).select(F.explode(moves).alias("m"), "v").select("m.*", "v")
    totals = [F.sum(F.col("sign") * F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(len(sums[0]))]
    for r in moved.groupBy("j").agg(F.sum("sign").alias("n"), *totals).collect():
        counts[r["j"]] += r["n"]
        sums[r["j"]] = [a + r[f"s{i}"] for i, a in enumerate(sums[r["j"]])]


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> Clusters | None:
    """Clusters after so many rounds of assignment and replacement and one more assignment; None if no vector is kept."""
    with scratch() as keep:
        state = cut(integers(vectors.select("vec_id", "embedding"), dimensions, scale))
        centroids = first_centroids(state, clusters, seed)
        if not len(centroids):
            return None
        before, k = centroids, len(centroids)
        sums, counts = [[0] * dimensions for _ in range(k)], [0] * k
        for r in range(rounds + 1):
            old, state = state, cut(assigned(state, Geometry.of(centroids, before), r == rounds))
            release(old)
            if r < rounds:
                add_moves(state, sums, counts)
                before = centroids
                centroids = np.array([[s // counts[j] for s in sums[j]] if counts[j] else before[j].tolist() for j in range(k)], np.int64)
        found = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        keep.append(state)
    return Clusters(state, centroids, [found.get(j, 0) for j in range(k)])


def by_cluster(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), F.col("cluster") + 1)
