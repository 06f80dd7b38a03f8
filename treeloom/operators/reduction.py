"""Centred principal components with unit-length output, fitted on one split and applied to others."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.kmeans import _matrix

#: Bound on the squared vector length: what the covariance takes on the driver.
MOST_DIMENSIONS = 4096


@dataclass
class Reduction:
    """Mean, components (rows, by falling variance) and their variances; ``total`` is the whole variance."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    whiten: bool = False

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros_like(self.variances)

    def save(self, path: str) -> None:
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump({"mean": self.mean.tolist(), "components": self.components.tolist(), "variances": self.variances.tolist(), "total": self.total, "whiten": self.whiten}, f)
        os.replace(f"{path}.tmp", path)

    @classmethod
    def load(cls, path: str, input_dim: int | None = None, output_dim: int | None = None) -> Reduction:
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        x = x.get("pca", x)  # alone, or in an envelope with other settings
        model = cls(np.array(x["mean"]), np.array(x["components"]), np.array(x["variances"]), x["total"], x["whiten"])
        if input_dim is not None and model.components.shape[1] != input_dim or output_dim is not None and model.components.shape[0] != output_dim:
            raise ValueError(f"the model maps {model.components.shape[1]} to {model.components.shape[0]} numbers")
        return model


def moments(units: DataFrame, vector: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (divided by n - 1) of all vectors: one pass, one matrix from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                ss = x.T @ x if ss is None else ss + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "ss"])

    n, s, ss = 0, None, None
    for r in units.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "n bigint, s array<double>, ss array<double>").collect():
        n += r["n"]
        s = np.array(r["s"]) if s is None else s + np.array(r["s"])
        ss = np.array(r["ss"]) if ss is None else ss + np.array(r["ss"])
    if not n:
        raise ValueError("no vectors to fit on")
    d = len(s)
    if d > MOST_DIMENSIONS:
        raise ValueError("vectors are too long for a covariance on the driver")
    mean = s / n
    return n, mean, (ss.reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1)


def fit(units: DataFrame, k: int, vector: str = "v", whiten: bool = False) -> Reduction:
    """The k leading components; each component's largest number is positive, which fixes its sign."""
    n, mean, cov = moments(units, vector)
    if not 1 <= k <= min(n, len(mean)):
        raise ValueError("k must lie between 1 and the smaller of rows and dimensions")
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])[:, None]
    return Reduction(mean, parts, np.maximum(values[order], 0), float(np.maximum(values, 0).sum()), whiten)


def transform(df: DataFrame, key: str, vector: str, model: Reduction, unit: bool = True, eps: float = 1e-12) -> DataFrame:
    """(key, reduced): centred, projected, and scaled to unit length (null below ``eps``, and for null or misfit vectors)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # k times the vectors' length
    d = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), d), False).to_numpy(zero_copy_only=False)
            x = batch.column(1).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(int(fits.sum()), d)
            good = np.isfinite(x).all(axis=1)  # a null number reads as NaN
            y = (x[good] - m.mean) @ m.components.T
            if m.whiten:
                y = y / np.sqrt(np.maximum(m.variances, 1e-300))
            norm = np.linalg.norm(y, axis=1)
            if unit:
                good[np.flatnonzero(good)[norm < eps]] = False
                y = y[norm >= eps] / norm[norm >= eps, None]
            there = np.zeros(batch.num_rows, bool)
            there[np.flatnonzero(fits)[good]] = True
            offsets = np.concatenate(([0], np.cumsum(there * y.shape[1]))).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, "reduced"])

    source = df.select(key, F.col(vector).cast("array<double>").alias("_v"))
    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, reduced array<double>")
