"""Seeded spherical k-means as a driver loop over one distributed step.

Only K centroids (times their length) and the sums of each task travel: a step is one pass in
which every task multiplies its vectors with the broadcast centroids and returns K sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.shingles import mix
from treeloom.functions.vectors import l2, valid
from treeloom.session import write_table

#: Bound on K times the vectors' length: what is broadcast and collected.
MOST_CENTROID_NUMBERS = 4_000_000


@dataclass
class KMeansResult:
    """Centroids (unit rows), counts, objective (mean of 1 - similarity), steps taken, whether it converged, and the seed."""

    centroids: np.ndarray
    counts: np.ndarray
    objective: float
    n_iterations: int
    converged: bool
    seed: int

    @property
    def active_clusters(self) -> int:
        return int((self.counts > 0).sum())

    @property
    def max_share(self) -> float:
        return float(self.counts.max() / max(1, self.counts.sum()))


def unit_rows(df: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """(row, v): unit vectors of one length, ``dim`` or else the most frequent one (the longest of equally frequent).

    Rows with a null key, null, NaN, infinite or zero vectors and those of another length are left out; of a repeated key the smallest vector counts.
    """
    if dim is None:
        length = df.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()  # one row per length
        dim = length["d"] if length else 0
    df = df.filter(F.size(vector) == dim)
    once = df.filter(F.col(key).isNotNull() & valid(F.col(vector))).groupBy(F.col(key).cast("bigint").alias("row")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    return once.select("row", l2(F.col("v")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 1))
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x @ c.T
    best = s.argmax(axis=1)  # the first of equal maxima
    return best, s[np.arange(len(x)), best]


def _share(spark: SparkSession, centroids: np.ndarray):  # noqa: ANN202
    if centroids.size > MOST_CENTROID_NUMBERS:
        raise ValueError("too many centroid numbers to broadcast")
    return spark.sparkContext.broadcast(np.ascontiguousarray(centroids, np.float64))


def assign(units: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(row, cluster, similarity): the most similar centroid, the lowest of equal ones."""
    shared = _share(units.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, sim = _nearest(_matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int64)), pa.array(sim)], ["row", "cluster", "similarity"])

    return units.select("row", "v").mapInArrow(run, "row bigint, cluster bigint, similarity double")


def _step(units: DataFrame, centroids: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray, float, int, list[tuple[float, int, np.ndarray]]]:
    """Sums and counts of all clusters, the sum of similarities, a hash of the labels, and the ``spare`` least similar rows."""
    shared = _share(units.sparkSession, centroids)
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, total, label_hash = np.zeros((k, d)), np.zeros(k, np.int64), 0.0, np.uint64(0)
        far: list[tuple[float, int, list[float]]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, row = _matrix(batch.column(1)), batch.column(0).to_numpy()
            best, sim = _nearest(x, shared.value)
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=k)
            total += float(sim.sum())
            mixed = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (best.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            label_hash += ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)
            at = np.lexsort((row, sim))[:k]
            far = sorted(far + [(float(sim[i]), int(row[i]), x[i].tolist()) for i in at], key=lambda t: t[:2])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([total]), pa.array([int(label_hash.view(np.int64))]), pa.array([[{"s": s, "r": r, "v": v} for s, r, v in far]], pa.list_(pa.struct([("s", pa.float64()), ("r", pa.int64()), ("v", pa.list_(pa.float64()))])))], ["sums", "counts", "total", "labels", "far"])

    parts = units.select("row", "v").mapInArrow(run, "sums array<double>, counts array<bigint>, total double, labels bigint, far array<struct<s: double, r: bigint, v: array<double>>>")
    sums, counts, total, labels, far = np.zeros((k, d)), np.zeros(k, np.int64), 0.0, 0, []
    for r in parts.collect():  # one row of K sums from each task
        sums += np.array(r["sums"]).reshape(k, d)
        counts += np.array(r["counts"])
        total += r["total"]
        labels = (labels + r["labels"]) % 2**64
        far = sorted(far + [(f["s"], f["r"], np.array(f["v"])) for f in r["far"]], key=lambda t: t[:2])[:spare]
    return sums, counts, total, labels, far


def plus_plus(units: DataFrame, k: int, seed: int, floor: float = 0.0) -> np.ndarray:
    """k-means++ by cosine distance: rows are drawn with chances in proportion to their distance from the centroids so far.

    Each draw is the row with the smallest ratio of an exponential variate, hashed from seed, round and row
    number, to its distance: the same as drawing by weight, in one pass and whatever the partitioning.  Each task
    returns its best row.  Distances are at least ``floor``; with floor 0 no row is drawn twice.  Where all distances
    vanish, rows count alike.
    """
    chosen: list[np.ndarray] = []
    taken: list[int] = []
    for turn in range(k):
        shared = units.sparkSession.sparkContext.broadcast((np.array(chosen), np.array(taken, np.int64)))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            centres, used = shared.value
            best: tuple[bool, float, int, list[float]] | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, row = _matrix(batch.column(1)), batch.column(0).to_numpy()
                d = np.maximum(1 - _nearest(x, centres)[1], floor) if len(centres) else np.ones(len(x))
                salt = np.uint64((seed * 1_000_003 + turn) * 0xD6E8FEB86659FD93 % 2**64)
                e = -np.log((mix(mix(row.astype(np.int64).view(np.uint64)) ^ salt) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54)
                free = ~np.isin(row, used) if floor <= 0 else np.ones(len(row), bool)
                for i in np.flatnonzero(free)[np.argsort(np.where(d > 1e-12, e / np.maximum(d, 1e-12), np.inf)[free], kind="stable")[:1]]:
                    at = (not d[i] > 1e-12, float(e[i] / max(d[i], 1e-12)), int(row[i]), x[i].tolist())
                    best = at if best is None else min(best, at)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]]), pa.array([best[3]], pa.list_(pa.float64()))], ["zero", "ratio", "row", "v"])

        found = units.select("row", "v").mapInArrow(run, "zero boolean, ratio double, row bigint, v array<double>").collect()  # one row from each task
        if not found:
            raise ValueError("fewer rows than clusters")
        drawn = min(found, key=lambda r: (r["zero"], r["ratio"], r["row"]))
        taken.append(drawn["row"])
        chosen.append(np.array(drawn["v"]))
    return np.array(chosen)


def lloyd(units: DataFrame, initial: np.ndarray, max_iter: int = 300, tolerance: float = 1e-6, stop: str = "labels_or_shift", seed: int = 0) -> KMeansResult:
    """Spherical Lloyd steps from ``initial``.

    An empty cluster takes one of the least similar rows, in ascending order; that row stays in its old cluster's sum for the
    step.  ``stop``: 'labels_or_shift' ends when no label changed or no centroid moved by more than the tolerance,
    'similarity_delta' when the mean similarity, taken before the centroids move, changed by less than it.
    """
    if stop not in ("labels_or_shift", "similarity_delta"):
        raise ValueError("unknown stop rule")
    if max_iter <= 0 or not tolerance >= 0:
        raise ValueError("max_iter must be positive and tolerance not negative")
    c = initial / np.maximum(np.linalg.norm(initial, axis=1, keepdims=True), 1e-12)
    k, before, mean_before, converged, steps = len(c), None, None, False, 0
    for steps in range(1, max_iter + 1):
        sums, counts, total, labels, far = _step(units, c, k)
        n = int(counts.sum())
        if n == 0:
            raise ValueError("no valid vectors")
        new = sums.copy()
        for spare, empty in enumerate(np.flatnonzero(counts == 0).tolist()):
            new[empty] = far[spare % len(far)][2]
        length = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(length > 1e-12, new / np.maximum(length, 1e-12), c)
        shift = float(np.linalg.norm(new - c, axis=1).max())
        c = new
        if stop == "labels_or_shift":
            converged = labels == before or shift <= tolerance
        else:
            converged = mean_before is not None and abs(total / n - mean_before) < tolerance
        before, mean_before = labels, total / n
        if converged:
            break
    _, counts, total, _, _ = _step(units, c, 1)
    return KMeansResult(c, counts, 1 - total / max(1, int(counts.sum())), steps, converged, seed)


def spherical_kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, max_iter: int = 300, tolerance: float = 1e-6, legacy: bool = False) -> tuple[DataFrame, KMeansResult]:
    """((row, cluster, similarity), result).  ``legacy``: distance floor 1e-8 in the draws and the similarity stop rule."""
    return run_seeds(df, key, vector, k, [seed], max_iter, tolerance, legacy)[0]


def run_seeds(df: DataFrame, key: str, vector: str, k: int, seeds: list[int], max_iter: int = 300, tolerance: float = 1e-6, legacy: bool = False) -> list[tuple[DataFrame, KMeansResult]]:
    """One clustering per seed, in order, over one written table of unit vectors."""
    if not seeds or len(set(seeds)) != len(seeds):
        raise ValueError("seeds must be given and unique")
    if k <= 1:
        raise ValueError("k must be greater than one")
    units, _ = write_table(unit_rows(df, key, vector), "units")
    if units.limit(k).count() < k:
        raise ValueError("k exceeds the number of valid vectors")
    out = []
    for seed in seeds:
        result = lloyd(units, plus_plus(units, k, seed, 1e-8 if legacy else 0.0), max_iter, tolerance, "similarity_delta" if legacy else "labels_or_shift", seed)
        out.append((assign(units, result.centroids), result))
    return out


def centroid_rows(df: DataFrame, cluster: str = "cluster_id", centroid: str = "centroid") -> np.ndarray:
    """Centroids of a small table as unit rows in the order of their ids."""
    rows = df.select(cluster, centroid).orderBy(cluster).limit(MOST_CENTROID_NUMBERS).collect()
    c = np.array([r[centroid] for r in rows], np.float64)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


__all__ = ["KMeansResult", "assign", "centroid_rows", "lloyd", "plus_plus", "run_seeds", "spherical_kmeans", "unit_rows"]
