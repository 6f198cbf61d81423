"""Centroid clustering of integer vectors, screened by block norms.

A vector of floats becomes integers once, floor(scale * x), and is kept beside the
norms of its equal segments. By Cauchy and Schwarz the product of two segments is at
most the product of their norms, so the squared distance of vector and centroid is at
least the sum over segments of (norm of one - norm of the other)^2. An assignment
reads this bound for all centroids from the short vectors of norms, takes the exact
integer distance to the centroid of the least bound, and then exact distances only to
centroids whose bound does not exceed it. Bounds are lowered by far more than their
rounding, so a centroid as near as the nearest is never screened out.

A round is one pass over the table of integers: each task sums the vectors of each
centroid, and the partial sums are added by a grouped sum. The driver sees one number
for each centroid and component. No vector is shuffled, whatever the clusters' sizes.

Integers of any size are exact: vectors beyond ``NARROW`` travel as decimals and use
Python's integers, and sums travel in limbs of 60 bits.

Defined cases: null, shorter and longer vectors and those with a null, NaN or infinite
component are left out; a null id hashes as an empty text; rows of one id count each
by itself, and where they compete to be a start, the smaller vector goes first; with
fewer vectors than centroids, each is a start; no vectors give no rows; distances and
inertias over the largest long are given as that. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import Scratch, map_arrow, session_of

#: Integers up to this size have squared distances and sums that fit 64 bits.
NARROW = 1 << 27
LIMB = 60
LONGEST = (1 << 63) - 1
#: Share by which a bound is lowered, against rounding of norms and sums.
SLACK = 1e-9
COUNT, SPREAD = -1, -2  # stand in for a component in partial sums


def _float(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf


def segment_norms(v: np.ndarray, segments: int) -> np.ndarray:
    """Norm of every segment of every row of an integer matrix."""
    parts = np.array_split(np.arange(v.shape[1]), segments)
    out = np.empty((len(v), len(parts)))
    for k, at in enumerate(parts):
        square = (v[:, at] * v[:, at]).sum(1)
        out[:, k] = [math.sqrt(_float(s)) for s in square] if v.dtype == object else np.sqrt(square.astype(float))
    return out


@dataclass(frozen=True)
class Centroids:
    """Integer centroids with their segments' norms."""

    rows: tuple[tuple[int, ...], ...]
    segments: int

    @property
    def wide(self) -> bool:
        return any(abs(x) >= NARROW for row in self.rows for x in row)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.rows]


def bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """At most the squared distance of each vector to each centroid."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = norms[:, None, :] - centroid_norms[None, :, :]
        size = norms[:, None, :] + centroid_norms[None, :, :]
        low = (gap * gap).sum(2) - SLACK * (size * size).sum(2)
    return np.where(np.isnan(low), -np.inf, low)


class Assigner:
    """Nearest centroid of batches of vectors, with the count of exact distances it took."""

    def __init__(self, centroids: Centroids):
        self.kind = object if centroids.wide else np.int64
        self.rows = np.array(centroids.rows, self.kind)
        self.norms = segment_norms(self.rows, centroids.segments)
        self.exact = 0

    def __call__(self, v: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equally near ones) and the squared distance."""
        kind = object if self.kind is object or v.dtype == object else np.int64
        c = self.rows.astype(kind)
        v = v.astype(kind)
        low = bounds(norms, self.norms)
        every = np.arange(len(v))
        first = low.argmin(1)
        gap = v - c[first]
        best = (gap * gap).sum(1)
        most = np.array([_float(b) for b in best]) if kind is object else best.astype(float)
        # bounds and exact distances differ by more than the rounding of the latter's conversion
        near = low <= (most * (1 + SLACK))[:, None]
        near[every, first] = False
        i, k = near.nonzero()
        gap = v[i] - c[k]
        found = (gap * gap).sum(1)
        self.exact += len(v) + len(i)
        if kind is object:
            cluster, distance = first.copy(), best.copy()
            for row, centroid, d in zip(i, k, found):
                if (d, centroid) < (distance[row], cluster[row]):
                    cluster[row], distance[row] = centroid, d
            return cluster, distance
        table = np.full(low.shape, LONGEST, np.int64)
        table[every, first] = best
        table[i, k] = found
        cluster = table.argmin(1)
        return cluster, table[every, cluster]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as 64-bit integers, or as Python's where one is too large for these."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not len(values) or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in values.tolist()], object).reshape(values.shape)


def _batches(values: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and integers of the narrow rows, then of the wide ones."""
    with np.errstate(over="ignore"):
        wide = (np.abs(values * scale) >= NARROW - 1).any(1)
    for at in ((~wide).nonzero()[0], wide.nonzero()[0]):
        if len(at):
            yield at, integers(values[at], scale)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A total as limbs of LIMB bits; the last one carries the sign."""
    limb = 0
    while not -(1 << LIMB) < total < 1 << LIMB:
        total, low = divmod(total, 1 << LIMB)
        yield limb, low
        limb += 1
    yield limb, total


def compressor(scale: int, dims: int, segments: int):
    """Batches of (vec_id, embedding) as (vec_id, code, wide, norms)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _matrix(b.column(1), dims)
            for at, v in _batches(values, scale):
                wide = v.dtype == object
                code = [",".join(map(str, row)).encode() for row in v] if wide else [row.tobytes() for row in v.astype("<i4")]
                norms = [row.tobytes() for row in segment_norms(v, segments)]
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(code, pa.binary()), pa.array([wide] * len(at)), pa.array(norms, pa.binary())], ["vec_id", "code", "wide", "norms"])

    return fn


def _decoded(b: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Integers and norms of a batch of (code, wide, norms)."""
    wide = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
    for flag in (False, True):
        at = pa.array((wide == flag).nonzero()[0])
        if len(at):
            code, norms = b.column(0).take(at).to_pylist(), b.column(2).take(at).to_pylist()
            v = np.array([[int(x) for x in c.split(b",")] for c in code], object) if flag else np.frombuffer(b"".join(code), "<i4").reshape(-1, dims).astype(np.int64)
            yield v, np.frombuffer(b"".join(norms)).reshape(len(at), -1)


def summer(centroids: Centroids, dims: int, spread: bool):
    """Partial sums of a task: of the components of each centroid's vectors, or of their distances."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, totals = Assigner(centroids), {}
        for b in batches:
            for v, norms in _decoded(b, dims):
                cluster, distance = assign(v, norms)
                for k in np.unique(cluster).tolist():
                    mine = cluster == k
                    add = {COUNT: int(mine.sum())}
                    if spread:
                        add[SPREAD] = sum(distance[mine].tolist())
                    else:
                        add.update(enumerate(v[mine].sum(0).tolist()))
                    for j, x in add.items():
                        totals[k, j] = totals.get((k, j), 0) + x
        rows = [(k, j, limb, x) for (k, j), total in totals.items() for limb, x in _limbs(total)]
        if rows:
            k, j, limb, x = zip(*rows)
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(x, pa.int64())], ["cluster", "component", "limb", "total"])

    return fn


def _summed(codes: DataFrame, centroids: Centroids, dims: int, spread: bool = False) -> dict[tuple[int, int], int]:
    """Total of each (cluster, component) over all vectors: at most clusters x (dims + 1) numbers."""
    parts = map_arrow(codes.select("code", "wide", "norms"), summer(centroids, dims, spread), "cluster int, component int, limb int, total long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        at = (r.cluster, r.component)
        out[at] = out.get(at, 0) + (int(r.total) << (LIMB * r.limb))
    return out


def updated(old: Centroids, sums: dict[tuple[int, int], int], dims: int) -> Centroids:
    """Floors of the means; a centroid without vectors stays."""
    rows = [tuple(sums[k, j] // sums[k, COUNT] for j in range(dims)) if (k, COUNT) in sums else row for k, row in enumerate(old.rows)]
    return Centroids(tuple(rows), old.segments)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the vectors with all components."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    return vectors.where((F.size("embedding") == dims) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def starts(kept: DataFrame, clusters: int, scale: int, segments: int, seed: int) -> Centroids:
    """The vectors with the smallest hashes of seed and id: at most ``clusters`` rows."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(named.alias("named"), "embedding").orderBy("named", "embedding").limit(clusters).collect()
    return Centroids(tuple(tuple(integers(np.array([r.embedding]), scale)[0].tolist()) for r in rows), segments)


def placer(centroids: Centroids, scale: int, dims: int, spread: dict[int, int]):
    """Batches of (vec_id, embedding) as final rows."""
    digests, whole = centroids.digests(), min(sum(spread.values()), LONGEST)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(centroids)
        for b in batches:
            for at, v in _batches(_matrix(b.column(1), dims), scale):
                cluster, distance = assign(v, segment_norms(v, centroids.segments))
                columns = {
                    "vec_id": b.column(0).take(pa.array(at)),
                    "cluster": pa.array(cluster, pa.int32()),
                    "distance": pa.array([min(d, LONGEST) for d in distance.tolist()], pa.int64()),
                    "cluster_inertia": pa.array([min(spread[k], LONGEST) for k in cluster.tolist()], pa.int64()),
                    "inertia": pa.array([whole] * len(at), pa.int64()),
                    "centroid_sha256": pa.array([digests[k] for k in cluster.tolist()]),
                }
                yield pa.record_batch(list(columns.values()), list(columns))

    return fn


def fit(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, segments: int = 8, seed: int = 1) -> tuple[Centroids, dict[int, int]]:
    """Centroids after the rounds, and each cluster's summed distance under them.

    The integers and norms are one table in the shared folder while this runs: each
    round reads it in place of the vectors, and a lost task reads its share again.
    """
    spark = session_of(vectors)
    kept = usable(vectors, dims)
    now = starts(kept, clusters, scale, segments, seed)
    if not now.rows:
        return now, {}
    tables = Scratch(spark)
    try:
        codes = tables.written(map_arrow(kept, compressor(scale, dims, segments), "vec_id long, code binary, wide boolean, norms binary"), "centroid-codes")
        for _ in range(rounds):
            now = updated(now, _summed(codes, now, dims), dims)
        sums = _summed(codes, now, dims, spread=True)
    finally:
        tables.drop()
    return now, {k: x for (k, j), x in sums.items() if j == SPREAD}


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, segments: int = 8, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    The result is a last pass over the vectors themselves and reads no table of the fit.
    """
    found, spread = fit(vectors, clusters, rounds, dims, scale, segments, seed)
    kept = usable(vectors, dims) if found.rows else usable(vectors, dims).where("false")
    return map_arrow(kept, placer(found, scale, dims, spread), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
