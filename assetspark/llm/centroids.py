"""Lloyd clustering in whole numbers, pruned by Ptolemy's inequality over fixed pivot pairs.

For four points x, c, p, q Ptolemy's inequality gives ``d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|``. The
distances of every vector to a few pivots are stored with it once; those of the centroids are new in every round. A vector's
exact distance to the centroid with the least bound rules out all centroids whose bounds lie above it; the others are
compared exactly. Bounds are rounded downwards, so pruning never changes an assignment.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PIVOTS = 6
#: Rows from which the pivots are chosen (they decide cost, never results).
PIVOT_ROWS = 256
#: Components up to this size have squared distances that a double holds exactly (64 components or fewer).
SMALL = float(1 << 22)
LIMBS, LIMB = 8, 32
_LONG = (1 << 63) - 1
_SLACK = 1e-9


@dataclass
class Clusters:
    """One row per vector (vec_id, cluster, distance) and the final centroids as whole numbers."""

    assigned: DataFrame
    centroids: list[list[int]]

    def digest(self) -> DataFrame:
        """assigned with cluster_inertia, inertia and centroid_sha256."""
        spark = self.assigned.sparkSession
        total = F.sum(F.col("distance").cast("decimal(38,0)"))
        sums = {r.cluster: int(r.total) for r in self.assigned.groupBy("cluster").agg(total.alias("total")).collect()}
        facts = [
            (c, min(_LONG, sums.get(c, 0)), min(_LONG, sum(sums.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
            for c, v in enumerate(self.centroids)
        ]
        named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return self.assigned.join(F.broadcast(named), "cluster").select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
        )


def cluster_vectors(
    vectors: DataFrame, k: int, rounds: int, dim: int, scale: float, seed: str, vec_id: str = "vec_id", vector: str = "embedding"
) -> Clusters:
    """Lloyd's rounds over the vectors with ``dim`` components, each component x taken as floor(scale * x).

    The first centroids are the ``k`` vectors with the smallest sha256 of seed + vec_id (null ids last, then the smaller
    components; fewer vectors make fewer centroids). Every round assigns all vectors to the nearest centroid (ties: the
    smaller number) and replaces each non-empty centroid by the floor of its vectors' mean; an empty one stays. Vectors that
    are null, have another length or hold null, NaN or infinite components (also after scaling) are left out; repeated rows
    and ids count each. Sums are exact at any size; distances and inertias beyond a long are shown as the largest
    long. Other columns are ignored; an empty table gives no rows.
    """
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    kept = (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
        .filter((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))))
        .withColumn("hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    )
    first = kept.orderBy(F.asc_nulls_last("hash"), "v").limit(max(k, PIVOT_ROWS)).collect()
    sample = [[int(math.floor(x)) for x in r.v] for r in first]
    centroids = sample[:k]
    pivots = _pivots(sample)
    stored = cut_lineage(kept.mapInArrow(lambda batches: _with_pivots(batches, pivots, dim), "vec_id long, v binary, d binary"))
    for _ in range(rounds if centroids else 0):
        now = centroids
        parts = stored.mapInArrow(lambda batches, now=now: _partial_sums(batches, now, pivots), _PARTIAL)
        sums = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)])
        centroids = [list(c) for c in now]
        for r in sums.collect():  # k * dim rows
            centroids[r.cluster][r.component] = sum(r[f"l{i}"] << (LIMB * i) for i in range(LIMBS)) // r.n
    last = centroids
    assigned = stored.mapInArrow(lambda batches: _assigned(batches, last, pivots), "vec_id long, cluster int, distance long")
    return Clusters(cut_lineage(assigned), centroids)


# ---------------------------------------------------------------- exact and pivot distances


def _lengths(x: np.ndarray, points: list[list[int]]) -> np.ndarray:
    """Distances in double precision, good to a few units of the last place of the values' size."""
    out = np.empty((len(x), len(points)))
    for j, p in enumerate(points):
        out[:, j] = np.sqrt(np.square(x - np.array(p, float)).sum(1))
    return out


def _pivots(sample: list[list[int]]) -> list[list[int]]:
    """Farthest-first choice out of the sample."""
    if not sample:
        return []
    x = np.array(sample, float)
    chosen, far = [0], _lengths(x, [sample[0]])[:, 0]
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _lengths(x, [sample[chosen[-1]]])[:, 0])
    return [sample[i] for i in chosen]


def _pairs(pivots: list[list[int]]) -> list[tuple[int, int]]:
    """The fixed pairs: each pivot with the next."""
    n = len(pivots)
    return [] if n < 2 else [(0, 1)] if n == 2 else [(i, (i + 1) % n) for i in range(n)]


def _with_pivots(batches: Iterator[pa.RecordBatch], pivots: list[list[int]], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        x = np.floor(flat).reshape(batch.num_rows, dim)
        d = _lengths(x, pivots)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), _binary(x), _binary(d)], ["vec_id", "v", "d"]
        )


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(rows, -1) if rows else np.zeros((0, 0))


def _lower_bounds(d: np.ndarray, centroids: list[list[int]], pivots: list[list[int]]) -> np.ndarray:
    """Ptolemaic lower bounds of the distances of every vector to every centroid, rounded downwards."""
    out = np.zeros((len(d), len(centroids)))
    if not pivots:
        return out
    to_pivots = _lengths(np.array(centroids, float), pivots)
    between = _lengths(np.array(pivots, float), pivots)
    for p, q in _pairs(pivots):
        if between[p, q] > 0:
            a, b = d[:, p, None] * to_pivots[None, :, q], d[:, q, None] * to_pivots[None, :, p]
            np.maximum(out, (np.abs(a - b) - _SLACK * (a + b)) / (between[p, q] * (1 + _SLACK)), out=out)
    return out


def _distance(x: list[float], c: list[int]) -> int:
    return sum((int(a) - b) ** 2 for a, b in zip(x, c, strict=True))


def nearest(x: np.ndarray, d: np.ndarray, centroids: list[list[int]], pivots: list[list[int]]) -> tuple[np.ndarray, list[int], int]:
    """Nearest centroid of every vector, the exact squared distance, and how many distances were computed."""
    n, k = len(x), len(centroids)
    bound = _lower_bounds(d, centroids, pivots)
    start = bound.argmin(1)
    if not n or x.shape[1] > 64 or np.abs(x).max() > SMALL or max(abs(a) for c in centroids for a in c) > SMALL:
        cluster, exact, looked = start.copy(), [], 0
        for i, row in enumerate(x.tolist()):
            best, at = _distance(row, centroids[start[i]]), int(start[i])
            looked += 1
            for j in range(k):
                # a bound is a double, so it is compared in whole numbers of any size
                if j != start[i] and int(math.floor(max(0.0, bound[i, j] * (1 - _SLACK)))) ** 2 <= best:
                    other = _distance(row, centroids[j])
                    looked += 1
                    if other < best or (other == best and j < at):
                        best, at = other, j
            cluster[i] = at
            exact.append(best)
        return cluster, exact, looked
    points = np.array(centroids, float)
    best = np.square(x - points[start]).sum(1)
    cluster, looked = start.copy(), n
    floor = np.square(bound * (1 - _SLACK))
    for j in range(k):
        open_rows = np.flatnonzero((start != j) & (floor[:, j] <= best))
        other = np.square(x[open_rows] - points[j]).sum(1)
        looked += len(open_rows)
        better = (other < best[open_rows]) | ((other == best[open_rows]) & (j < cluster[open_rows]))
        best[open_rows[better]] = other[better]
        cluster[open_rows[better]] = j
    return cluster, best.astype(np.int64).tolist(), looked


# ---------------------------------------------------------------- rounds

_PARTIAL = "cluster int, component int, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS))


def _limbs(total: int) -> list[int]:
    """A whole number as parts of LIMB bits; only the last may be negative. Sums of parts stay longs."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _partial_sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], pivots: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Per task and cluster the exact sums of all components."""
    totals: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, d = _matrix(batch.column("v"), batch.num_rows), _matrix(batch.column("d"), batch.num_rows)
        cluster, _, _ = nearest(x, d, centroids, pivots)
        small = np.abs(x).max() <= SMALL  # sums of a batch below 2^53
        for c in np.unique(cluster).tolist():
            mine = x[cluster == c]
            sums = mine.sum(0).astype(np.int64).tolist() if small else [sum(map(int, column)) for column in mine.T.tolist()]
            held = totals.setdefault(c, [0] * x.shape[1])
            totals[c] = [a + b for a, b in zip(held, sums, strict=True)]
            counts[c] = counts.get(c, 0) + len(mine)
    rows = [[c, i, counts[c], *_limbs(s)] for c, sums in totals.items() for i, s in enumerate(sums)]
    if rows:
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (LIMBS + 1)]
        names = ["cluster", "component", "n", *[f"l{i}" for i in range(LIMBS)]]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], pivots: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, d = _matrix(batch.column("v"), batch.num_rows), _matrix(batch.column("d"), batch.num_rows)
        cluster, exact, _ = nearest(x, d, centroids, pivots)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([min(_LONG, e) for e in exact], pa.int64())],
            ["vec_id", "cluster", "distance"],
        )
