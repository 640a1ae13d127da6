"""Centroid clustering with Walsh-Hadamard progressive search.

Vectors become integers; so do centroids, and so does their Walsh-Hadamard transform,
whose rows are put in order of their number of sign changes.  The squared distance of two
transforms is 64 times that of the vectors, and the sum over the first coefficients never
exceeds it.  A task adds squared differences from coarse coefficients to fine ones; the
centroid that leads after the coarsest is finished first, and centroids whose sum so far
is strictly greater than a finished distance leave.  Those that stay get all 64
coefficients, so ties are seen and go to the smaller number.

Tasks answer with sums and counts per cluster, which are added up before they are
shuffled; the driver sees one row per cluster and component, whatever the input."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintlake.plans.storage import saved

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
_STEPS = (4, 8, 16, 32, 64)
#: Components up to this size keep all sums within 63 bits; greater ones are handled as
#: Python integers by the same code.
_EXACT = 1 << 20
_MOST = (1 << 63) - 1


def hadamard(n: int = DIMENSIONS) -> np.ndarray:
    """Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


_H = hadamard()


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller) and the squared distance."""
    x, c = vectors @ _H.T, centroids @ _H.T
    n, k = len(x), len(c)
    row, who = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, x.dtype)
    best = None
    for lo, hi in zip((0, *_STEPS), _STEPS, strict=False):
        part = part + ((x[row, lo:hi] - c[who, lo:hi]) ** 2).sum(axis=1)
        if best is None:
            lead = part.reshape(n, k).argmin(axis=1)
            best = ((x - c[lead]) ** 2).sum(axis=1)
        if hi < DIMENSIONS:
            stays = part <= best[row]
            row, who, part = row[stays], who[stays], part[stays]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if n else np.zeros(0, np.int64)
    least = np.minimum.reduceat(part, first) if n else part
    at = np.flatnonzero(part == least[row])  # ascending, so the first of a row is the smaller number
    winner = np.zeros(n, np.int64)
    winner[row[at][::-1]] = who[at][::-1]
    return winner, least // DIMENSIONS


def _integers(column: pa.Array) -> np.ndarray:
    """Vectors as rows of floor(64 x)."""
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, DIMENSIONS)
    if not len(flat) or np.abs(flat).max() < _EXACT // SCALE:
        return np.floor(flat * SCALE).astype(np.int64)
    # Whole numbers of doubles have no limit in Python, and SCALE is a power of two.
    return np.array([[(lambda a, b: a * SCALE // b)(*v.as_integer_ratio()) for v in r] for r in flat.tolist()], object)


def kept(rows: DataFrame, vector: str) -> Column:
    x = F.col(vector)
    return F.coalesce((F.size(x) == DIMENSIONS) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per kept row of `rows`: the key, the `carry` columns, cluster, distance,
    cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of 64 components, none null or non-finite.  Centroids start as the
    vectors with the smallest sha256 of `1:<key>` (a null key counts as an empty one; rows
    that repeat a key follow by key, then vector), which is one top-k of `clusters` rows.
    With fewer vectors there are fewer clusters, without any there is no row.  Empty
    clusters keep their centroid.  Distances and inertias beyond 63 bits are given as the
    largest long; assignment and centroids stay exact.  Columns of `rows` not named in
    `carry` are ignored, whatever their names."""
    spark = rows.sparkSession
    names = [f"carry_{i}" for i in range(len(carry))]
    x = rows.select(F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
                    F.col(vector).cast("array<double>").alias("vector"))
    x = x.where(kept(x, "vector"))
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    start = x.select(seed.alias("seed"), "key", "vector").orderBy("seed", "key", "vector").limit(clusters).collect()
    if not start:
        centers = np.zeros((0, DIMENSIONS), np.int64)
    else:
        centers = _integers(pa.array([r.vector for r in start], pa.list_(pa.float64())))
    vectors = x.select("vector")
    for _ in range(rounds if len(centers) else 0):
        sums = vectors.mapInArrow(_summed(centers), "cluster int, component int, total decimal(38,0), n long")
        told = sums.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        moved = centers.astype(object)
        for r in told:
            moved[r.cluster, r.component] = int(r.total) // r.n
        centers = _narrow(moved)
    kind = {f.name: f.dataType.simpleString() for f in x.schema}
    columns = ["key", *names]
    found = saved(x.mapInArrow(_assigned(centers, columns), ", ".join(f"{c} {kind[c]}" for c in columns) + ", cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    labels = [F.struct(F.lit(min(inertia.get(i, 0), _MOST)).cast("long").alias("own"), F.lit(s).alias("sha")) for i, s in enumerate(shas)]
    label = F.get(F.array(*labels), F.col("cluster")) if labels else F.lit(None).cast("struct<own:long,sha:string>")
    return found.select(F.col("key").alias(key), *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "cluster", "distance",
                        label["own"].alias("cluster_inertia"), F.lit(min(sum(inertia.values()), _MOST)).cast("long").alias("inertia"),
                        label["sha"].alias("centroid_sha256"))


def _narrow(centers: np.ndarray) -> np.ndarray:
    return centers.astype(np.int64) if np.abs(centers).max(initial=0) < _EXACT else centers


def _alike(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, centers) if x.dtype == centers.dtype else (x.astype(object), centers.astype(object))


def _summed(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(centers), DIMENSIONS), object), np.zeros(len(centers), np.int64)
        for batch in batches:
            x, c = _alike(_integers(batch["vector"]), centers)
            who, _ = nearest(x, c)
            for i in np.unique(who).tolist():
                mine = x[who == i]
                total[i] += mine.sum(axis=0).astype(object)
                n[i] += len(mine)
        which = np.repeat(np.flatnonzero(n), DIMENSIONS)
        flat = total[np.flatnonzero(n)].reshape(-1).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.tile(np.arange(DIMENSIONS), len(which) // DIMENSIONS), pa.int32()),
                                          pa.array(flat, pa.decimal128(38, 0)), pa.array(n[which], pa.int64())], ["cluster", "component", "total", "n"])
    return run


def _assigned(centers: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, distance = nearest(*_alike(_integers(batch["vector"]), centers)) if batch.num_rows else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(who, pa.int32()), pa.array([min(d, _MOST) for d in distance.tolist()], pa.int64())],
                                             [*columns, "cluster", "distance"])
    return run
