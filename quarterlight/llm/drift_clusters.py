"""Lloyd's clustering on whole-number vectors, with lower bounds that are loosened by geometry.

Every vector keeps its cluster, an upper bound on the distance to that centroid and a lower bound on the distance to any
other one.  When centroids have moved, the lower bound must give way for the largest approach of any other centroid.  The full drift
of a centroid is always enough, but a cluster's members lie in a sphere around their centroid, whose radius is
known from the upper bounds, and seen from a centroid that moves, this sphere fills a cone.  In the plane of the two
centroids and the move, ``approach`` bounds how much nearer the moved centroid can come to any point of the sphere: less
than the drift when it moves past the sphere, nothing or less when it moves away.  A vector whose upper bound
stays under its lower bound keeps its cluster; for the others the upper bound is made exact, and those that are still
ambiguous are compared with all centroids.

Distances are whole numbers and exact, so bounds (with a margin for rounding) only save work.  Vectors stay on the
executors; in each round, one row of sums for each cluster and task is added up in Spark, and k centroids of ``dims`` numbers come to
the driver.  A round is a map without a shuffle; its state is kept by the executors, and a lost part is computed again from the one
before.  Every ``CUT`` rounds, the state is written below ``spark.checkpoint.dir``, so that this chain stays short.

Defined results: vectors with another number of components, or with a missing, infinite or undefined one, are left out; rows that
repeat an id are vectors of their own; a vector without id takes part, and starts a centroid only when the others are too few;
where ids repeat, the smaller components start first; with fewer vectors than clusters, there are as many clusters as vectors;
without any, the result is empty.  Whole numbers are held to 2^62, and a distance that does not fit 63 bits is the largest that does.
Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.common import map_batches, map_rows
from quarterlight.session import stored

SCALE, CUT = 1024, 5
#: Up to this size, products and sums of squares of whole numbers are exact in float64.
EXACT = 1 << 21
LARGEST, MARGIN = (1 << 63) - 1, 1e-4
STATE = "vec_id long, x array<long>, cluster int, upper double, lower double, distance long"


def whole_numbers(table: DataFrame, dims: int, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, x array<long>: floor(scale * component) of the vectors that are kept."""
    values = F.col(column)
    sound = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = F.lit(1 << 62)
    whole = F.transform(values, lambda v: F.greatest(-bound, F.least(bound, F.floor(v.cast("double") * F.lit(float(scale))))))
    return table.filter(F.size(values) == dims).filter(sound).select(F.col(id_column).alias("vec_id"), whole.alias("x"))


def approach(center: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> float:
    """How much nearer to any point of a sphere a centroid can have come by its move.

    Seen from ``before``, a point at bearing t and distance d comes nearer by d - sqrt(d^2 + m^2 - 2 d m cos t), m being the
    length of the move.  This grows with d and falls with t, so the sphere's farthest distance and smallest bearing bound it.
    """
    move, there = after - before, center - before
    m, s = float(np.linalg.norm(move)), float(np.linalg.norm(there))
    if m == 0:
        return 0.0
    bearing = 0.0
    if s > radius:
        bearing = max(0.0, math.acos(max(-1.0, min(1.0, float(there @ move) / (s * m)))) - math.asin(radius / s) - 1e-9)
    d, along = s + radius, m * math.cos(bearing)
    # d - root, without taking large numbers from each other
    nearer = (2 * d * along - m * m) / (d + math.sqrt(max(0.0, d * d + m * m - 2 * d * along)))
    return min(m, nearer) + MARGIN


@dataclass
class Step:
    """Centroids, and for each cluster what its members' bounds change by since the last assignment."""

    centroids: list[list[int]]
    raised: np.ndarray = field(default=None)
    loosened: np.ndarray = field(default=None)

    @classmethod
    def after(cls, before: list[list[int]], centroids: list[list[int]], radii: list[float]) -> Step:
        old, new = np.array(before, float), np.array(centroids, float)
        k = len(old)
        raised = np.linalg.norm(new - old, axis=1) + MARGIN
        loosened = [max((approach(old[i], radii[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) for i in range(k)]
        return cls(centroids, raised, np.array(loosened))

    def squared(self, x: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Exact squared distances to all centroids, or of each vector to one."""
        c = np.array(self.centroids, object)
        if max(np.abs(x).max(initial=0), max(abs(v) for row in self.centroids for v in row)) <= EXACT:
            x, c = x.astype(float), c.astype(float)
            if which is not None:
                return ((x - c[which]) ** 2).sum(axis=1).astype(np.int64)
            return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
        x = x.astype(object)
        if which is not None:
            return ((x - c[which]) ** 2).sum(axis=1)
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster (the smaller number of equals), upper and lower bound."""
        squares = self.squared(x)
        if squares.dtype == object:  # huge numbers: no bound is kept, they are compared in every round
            own = np.array([min(range(len(row)), key=row.__getitem__) for row in squares], np.int32)
            return own, np.sqrt([float(r[i]) for r, i in zip(squares, own)]) * (1 + 1e-9), np.full(len(x), -math.inf)
        own = squares.argmin(axis=1).astype(np.int32)
        two = np.sqrt(np.partition(squares, 1, axis=1)[:, :2]) if squares.shape[1] > 1 else np.stack([np.sqrt(squares[:, 0]), np.full(len(x), math.inf)], axis=1)
        return own, two[:, 0], two[:, 1]

    def assign(self, x: np.ndarray, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds, and how many vectors were compared with all centroids."""
        if own is None:
            return *self.scan(x), len(x)
        own, upper, lower = own.copy(), upper + self.raised[own], lower - self.loosened[own]
        left = np.flatnonzero(~(upper + MARGIN < lower))
        upper[left] = np.sqrt(self.squared(x[left], own[left]).astype(float)) * (1 + 1e-12)
        left = left[~(upper[left] + MARGIN < lower[left])]
        if len(left):
            own[left], upper[left], lower[left] = self.scan(x[left])
        return own, upper, lower, len(left)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assigned(state: DataFrame, step: Step, dims: int, last: bool = False) -> DataFrame:
    """The state after one assignment; ``distance`` is filled in the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, values, *rest = batch.columns[:5]
            x = matrix(values, dims)
            own, upper, lower = (None, None, None) if rest[0].null_count else (c.to_numpy(zero_copy_only=False) for c in rest)
            own, upper, lower, _ = step.assign(x, own, upper, lower)
            distance = pa.nulls(len(x), pa.int64())
            if last:
                distance = pa.array([min(LARGEST, int(d)) for d in step.squared(x, own)], pa.int64())
            columns = [ids, values, pa.array(own, pa.int32()), pa.array(upper), pa.array(lower), distance]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "lower", "distance"])

    return map_batches(state, run, STATE)


def sums(state: DataFrame, k: int, dims: int) -> list[tuple[int, list[int], float]]:
    """Number of members, exact componentwise sums and radius of every cluster; a row of each task and cluster is shuffled."""

    def run(rows):
        n, total, radius = [0] * k, [[0] * dims for _ in range(k)], [0.0] * k
        pending: list[list] = []

        def add():
            x, own, upper = np.array([p[0] for p in pending], object), np.array([p[1] for p in pending]), [p[2] for p in pending]
            if max(abs(x.max()), abs(x.min())) <= EXACT:
                x = x.astype(np.int64)
            for i in set(own.tolist()):
                mine = own == i
                n[i] += int(mine.sum())
                total[i] = [a + int(b) for a, b in zip(total[i], x[mine].sum(axis=0))]
                radius[i] = max(radius[i], max(u for u, m in zip(upper, mine) if m))
            pending.clear()

        for row in rows:
            pending.append(row)
            if len(pending) >= 4096:
                add()
        if pending:
            add()
        for i in range(k):
            if n[i]:
                yield i, n[i], [str(v) for v in total[i]], radius[i]

    parts = map_rows(state.select("x", "cluster", "upper"), run, "cluster int, n long, total array<string>, radius double")
    cells = parts.select("cluster", "n", "radius", F.posexplode("total").alias("place", "value"))
    cells = cells.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [(0, [0] * dims, 0.0) for _ in range(k)]
    for cluster, place, n, radius, value in cells.collect():  # k * dims rows
        out[cluster][1][place] = int(value)
        out[cluster] = (n, out[cluster][1], radius)
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = vectors.select("x", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return [list(r["x"]) for r in top]


def cluster(
    table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    vectors = whole_numbers(table, dims, SCALE, id_column, column)
    centroids = first_centroids(vectors, k, seed)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("distance", "long"))]
    state, kept = vectors.select("vec_id", "x", *none), None
    step = Step(centroids)
    for turn in range(rounds if centroids else 0):
        state = assigned(state, step, dims)
        if (turn + 1) % CUT:
            state = state.persist()
            held = state
        else:
            state, held = stored(state.drop("distance"), "assigned").withColumn("distance", F.lit(None).cast("long")), None
        found = sums(state, len(centroids), dims)
        if kept is not None:
            kept.unpersist()
        kept = held
        moved = [[v // n for v in total] if n else before for before, (n, total, _) in zip(centroids, found)]
        step, centroids = Step.after(centroids, moved, [r for *_, r in found]), moved
    done = assigned(state, step, dims, last=True) if centroids else state
    done = stored(done.select("vec_id", "cluster", "distance"), "clusters")
    if kept is not None:
        kept.unpersist()
    inertia = [0] * max(1, len(centroids))
    for i, total in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect():  # k rows
        inertia[i] = int(total)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    return done.select(
        "vec_id", "cluster", "distance", at([min(LARGEST, v) for v in inertia]).cast("long").alias("cluster_inertia"),
        F.lit(min(LARGEST, sum(inertia))).cast("long").alias("inertia"), at(digests).alias("centroid_sha256"),
    )
