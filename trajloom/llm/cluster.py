"""Exact k-means on integers by deltas: persisted assignments, and global sums that change by signed transfers only."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, lean, small_batches

#: Products of a block of vectors with all centroids that a worker holds at a time.
CELLS = 1 << 21
OWNER, DISTANCE, MOVED = "__owner", "__distance", "__moved"


def reach(dims: int) -> int:
    """The largest size of a component for which squared distances of so many components fit a long."""
    return math.isqrt(((1 << 63) - 1) // (4 * max(dims, 1)))


def integer_vectors(df: DataFrame, dims: int, scale: int, id: str, vector: str) -> DataFrame:
    """id, __points array<int> of the vectors with exactly `dims` components, none null or non-finite: floor(scale * x), x as double.

    A component too large for distances in a long ends the job with an error; it isn't dropped or clipped.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    most = min(reach(dims), (1 << 31) - 1)
    cell = lambda x: F.when(F.abs(x.cast("double") * scale) < most, F.floor(x.cast("double") * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {most}, so distances would not fit a long")).cast("int")
    )
    kept = df.select(F.col(id), F.col(vector).alias("__vector")).filter((F.size("__vector") == dims) & F.forall("__vector", finite))
    return kept.select(id, F.transform("__vector", cell).alias("__points"))


def seeds(vectors: DataFrame, id: str, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in ascending order; ids that are null come last, equal ids by their vectors."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)
    first = vectors.select("__points", rank.alias("__rank")).orderBy(F.asc_nulls_last("__rank"), "__points").limit(k).collect()
    return np.array([r["__points"] for r in first], np.int64)


def points_of(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors to integer centroids, exact: by floating point only where every partial sum is an exact integer."""
    dims = x.shape[1]
    if dims * int(np.abs(x).max(initial=0)) * int(np.abs(c).max(initial=0)) < 1 << 53:
        cross = (x.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        cross = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * cross + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids marked in `changed` are where they are now; owner -1: none yet.

    A vector whose owner stays where it was compares it with the changed ones only: the others were no
    better before and have not moved. One whose owner moved is compared with all.
    """
    owner, distance = owner.copy(), distance.copy()
    moved = (owner < 0) | changed[owner]
    if moved.any():
        d = distances(x[moved], centroids)
        best = d.argmin(1)  # of ties the smaller number
        owner[moved], distance[moved] = best, d[np.arange(len(d)), best]
    rest, among = np.flatnonzero(~moved), np.flatnonzero(changed)
    if len(rest) and len(among):
        d = distances(x[rest], centroids[among])
        at = d.argmin(1)
        best, number = d[np.arange(len(d)), at], among[at]
        wins = (best < distance[rest]) | ((best == distance[rest]) & (number < owner[rest]))
        owner[rest[wins]], distance[rest[wins]] = number[wins], best[wins]
    return owner, distance


def assigner(centroids: np.ndarray, changed: np.ndarray) -> Callable:
    """Batches of id, points, owner, distance to the same with new owners, and the owner before."""
    dims, step = centroids.shape[1], max(1, CELLS // len(centroids))

    @lean
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                was = some.column(2).to_numpy().astype(np.int64)
                owner, distance = nearest(points_of(some.column(1), dims), was, some.column(3).to_numpy(), centroids, changed)
                columns = [some.column(0), some.column(1), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names[:4], MOVED])

    return assign


def transfers(k: int, dims: int) -> Callable:
    """A task's signed sums: what vectors with a new owner add to it and take from the one before; the count is the last component."""

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = np.ones((batch.num_rows, dims + 1), np.int64)
            x[:, :dims] = points_of(batch.column(0), dims)
            for column, sign in ((1, 1), (2, -1)):
                owner = batch.column(column).to_numpy().astype(np.int64)
                order = np.argsort(owner, kind="stable")
                order = order[np.searchsorted(owner[order], 0) :]
                if len(order):
                    found, starts = np.unique(owner[order], return_index=True)
                    sums[found] += sign * np.add.reduceat(x[order], starts)
        where = np.argwhere(sums)
        if len(where):
            yield pa.RecordBatch.from_arrays([pa.array(where[:, 0], pa.int32()), pa.array(where[:, 1], pa.int32()), pa.array(sums[where[:, 0], where[:, 1]], pa.int64())], names=["k", "dim", "sum"])

    return add


@dataclass
class Trace:
    """What each round did: the number of centroids that changed."""

    changed: list[int] = field(default_factory=list)


def delta_lloyd(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id: str = "vec_id", vector: str = "embedding", trace: Trace | None = None) -> DataFrame:
    """Lloyd's rounds over integer vectors, exact: id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector.

    Kept are vectors with exactly `dims` components, none null or non-finite, as integers floor(scale * x). Centroids 0, 1, ... start as
    the k with the smallest sha256 of "<seed>:<id>"; fewer vectors make fewer centroids. Each round assigns all to the nearest centroid
    (ties: the smaller number) and replaces every centroid that has vectors by the floor of their mean. Then they are assigned once more.

    Assignments are persisted: each round writes a table of id, vector, owner and distance in the shared folder, and deletes the one
    before. A vector is compared with changed centroids only, or with all if its owner changed; the sums of all clusters change by what
    the vectors with a new owner bring and take, added up in each task first. A round after which no centroid changed ends the loop.
    The driver holds k * (dims + 1) integers. The tables of the last assignment stay for the lazy result.

    Null vectors are not kept; equal vectors and rows that repeat are vectors of their own; null ids are kept, and are seeds only after
    all others; an empty table gives an empty table. Other columns of df are not returned.
    """
    spark = df.sparkSession
    small_batches(spark)
    tables, trace = Tables(spark), trace if trace is not None else Trace()
    vectors = integer_vectors(df, dims, scale, id, vector)
    centroids = seeds(vectors, id, k, seed)
    kind = df.schema[id].dataType
    n = len(centroids)
    if not n:
        return vectors.select(id, *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).limit(0)
    sums, changed = np.zeros((n, dims + 1), object), np.ones(n, bool)
    owned = T.StructType([T.StructField(id, kind), T.StructField("__points", T.ArrayType(T.IntegerType())), T.StructField(OWNER, T.IntegerType()), T.StructField(DISTANCE, T.LongType()), T.StructField(MOVED, T.IntegerType())])
    state = vectors.withColumns({OWNER: F.lit(-1), DISTANCE: F.lit(0).cast("long")})
    for r in range(rounds + 1):
        if r and not changed.any():
            break
        state = tables.write(state.select(id, "__points", OWNER, DISTANCE).mapInArrow(assigner(centroids, changed), owned), f"round{r}")
        if r:
            tables.remove(f"round{r - 1}")
        if r == rounds:
            break
        own = state.filter(F.col(OWNER) != F.col(MOVED)).select("__points", OWNER, MOVED).mapInArrow(transfers(n, dims), "k int, dim int, sum long")
        for x in own.groupBy("k", "dim").agg(F.sum("sum").alias("sum")).collect():
            sums[x["k"], x["dim"]] += x["sum"]
        fresh = centroids.copy()
        for c in range(n):
            if sums[c, dims]:
                fresh[c] = [s // sums[c, dims] for s in sums[c, :dims]]
        changed = (fresh != centroids).any(1)
        trace.changed.append(int(changed.sum()))
        centroids = fresh
    inertia = {x[OWNER]: x["inertia"] for x in state.groupBy(OWNER).agg(F.sum(DISTANCE).alias("inertia")).collect()}
    digest = lambda c: hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest()
    rows = [(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    found = state.select(id, F.col(OWNER).alias("cluster"), F.col(DISTANCE).alias("distance"))
    return found.join(F.broadcast(clusters), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
