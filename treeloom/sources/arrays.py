"""NumPy files: keys, matrices, feature archives and label vectors, read on the executors in blocks of rows.

Only headers and plain numbers are read; object arrays, which are pickled code, are refused.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources.readers import list_files

_BLOCK_NUMBERS = 1 << 20


class ArrayError(ValueError):
    """A file does not hold the array it should."""


def open_file(path: str) -> pa.NativeFile:
    """A file of any file system that pyarrow knows, by path or URI."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _header(stream: io.IOBase) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(stream)
    if kind.hasobject:
        raise ArrayError("object arrays are not read")
    return shape, by_column, kind


def _blocks(stream: io.IOBase) -> Iterator[np.ndarray]:
    """The array in blocks along its first axis, so that a file of any size fits; arrays stored by column come in one piece."""
    shape, by_column, kind = _header(stream)
    row = math.prod(shape[1:])
    rows = shape[0] if shape else 1
    if by_column and len(shape) > 1:
        yield np.frombuffer(stream.read(rows * row * kind.itemsize), kind).reshape(shape, order="F")
        return
    step = max(1, _BLOCK_NUMBERS // max(1, row))
    for at in range(0, rows, step):
        n = min(step, rows - at)
        data = stream.read(n * row * kind.itemsize)
        if len(data) != n * row * kind.itemsize:
            raise ArrayError("the file ends before its array does")
        yield np.frombuffer(data, kind).reshape(n, *shape[1:])


def _members(path: str) -> Iterator[tuple[str, io.IOBase]]:
    """(name, stream) of each array of a file; a plain .npy file has one without a name."""
    with open_file(path) as f:
        if path.endswith(".npz"):
            with zipfile.ZipFile(f) as archive:
                for name in archive.namelist():
                    with archive.open(name) as stream:
                        yield name.removesuffix(".npy"), stream
        else:
            yield "", f


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """One task per file, about: only names travel."""
    return list_files(spark, path, pattern).select("path").repartition("path")


def npz_keys(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """(path, key, n_rows, n_columns, dtype) of every array of the archives below ``path``; contents are not read.  A vector has one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                for key, stream in _members(name):
                    shape, _, kind = _header(stream)
                    out.append((name, key, shape[0] if shape else 1, math.prod(shape[1:]), str(kind)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "key", "n_rows", "n_columns", "dtype"])

    return _files(spark, path, pattern).mapInArrow(run, "path string, key string, n_rows bigint, n_columns bigint, dtype string")


def _checked(df: DataFrame, expected_rows: int | None, expected_dim: int | None) -> DataFrame:
    if expected_rows is None and expected_dim is None:
        return df
    told = df.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).first()
    if expected_rows is not None and told["n"] != expected_rows:
        raise ArrayError(f"expected {expected_rows} rows, found {told['n']}")
    if expected_dim is not None and told["n"] and (told["least"], told["most"]) != (expected_dim, expected_dim):
        raise ArrayError(f"expected {expected_dim} numbers in a row, found {told['least']} to {told['most']}")
    return df


def read_matrix(spark: SparkSession, path: str, key: str = "", expected_rows: int | None = None, expected_dim: int | None = None, pattern: str | None = None) -> DataFrame:
    """(path, row_idx, features) of a matrix in each file below ``path``: the array named ``key`` of .npz archives, or .npy files where it is empty.

    ``row_idx`` counts a file's rows from 0.  Arrays that are no matrix of numbers, NaN, infinite numbers, a missing key and - where
    they are given - other numbers of rows in all or of columns raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                seen = []
                for member, stream in _members(name):
                    seen.append(member)
                    if member != key:
                        continue
                    at = 0
                    for block in _blocks(stream):
                        if block.ndim != 2 or block.dtype.kind not in "fiu":
                            raise ArrayError(f"{name} {key}: not a matrix of numbers")
                        x = np.ascontiguousarray(block, np.float32)
                        if not np.isfinite(x).all():
                            raise ArrayError(f"{name} {key}: holds NaN or infinite numbers")
                        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(at, at + len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["path", "row_idx", "features"])
                        at += len(x)
                if key not in seen:
                    raise ArrayError(f"{name} has no array {key!r}; there are {', '.join(seen)}")

    df = _files(spark, path, pattern or ("*.npz" if key else "*.npy")).mapInArrow(run, "path string, row_idx bigint, features array<float>")
    return _checked(df, expected_rows, expected_dim)


def _vector(spark: SparkSession, path: str, key: str, pattern: str, kind: str) -> DataFrame:
    """(path, row_idx, value) of a vector, or a matrix of one column, in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for member, stream in _members(name):
                    if member != key:
                        continue
                    at = 0
                    for block in _blocks(stream):
                        if block.ndim == 0 or math.prod(block.shape[1:]) != 1:
                            raise ArrayError(f"{name} {key}: not a vector")
                        flat = block.reshape(-1)
                        if kind == "bigint" and flat.dtype.kind not in "iu":
                            raise ArrayError(f"{name} {key}: not a vector of whole numbers")
                        value = pa.array(flat.astype(np.int64)) if kind == "bigint" else pa.array([str(v) for v in flat.tolist()])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array(np.arange(at, at + len(flat))), value], ["path", "row_idx", "value"])
                        at += len(flat)

    return _files(spark, path, pattern).mapInArrow(run, f"path string, row_idx bigint, value {kind}")


def read_features(spark: SparkSession, path: str, expected_rows: int | None = None, expected_dim: int | None = None, vectors: str = "features", ids: str = "patent_ids", pattern: str = "*.npz") -> DataFrame:
    """(path, row_idx, patent_id, features) of feature archives; ids that are missing, left over or occur twice raise an error."""
    x = read_matrix(spark, path, vectors, expected_rows, expected_dim, pattern)
    both = x.join(_vector(spark, path, ids, pattern, "string").withColumnRenamed("value", "patent_id"), ["path", "row_idx"], "full_outer")
    told = both.agg(F.count("*").alias("n"), F.countDistinct("patent_id").alias("ids"), F.count_if(F.col("features").isNull() | F.col("patent_id").isNull()).alias("alone")).first()
    if told["alone"] or told["ids"] != told["n"]:
        raise ArrayError(f"{told['alone']} rows without vector or id, {told['n'] - told['ids']} repeated ids")
    return both.select("path", "row_idx", "patent_id", "features")


def read_predictions(spark: SparkSession, path: str, expected_rows: int | None = None, key: str = "", pattern: str | None = None) -> DataFrame:
    """(path, row_idx, label) of saved label vectors of whole numbers; a matrix of one column counts as a vector."""
    df = _vector(spark, path, key, pattern or ("*.npz" if key else "*.npy"), "bigint").withColumnRenamed("value", "label")
    if expected_rows is not None and (n := df.count()) != expected_rows:
        raise ArrayError(f"expected {expected_rows} labels, found {n}")
    return df


def save_archives(df: DataFrame, path: str, key: str, vector: str, vectors: str = "features", ids: str = "patent_ids") -> DataFrame:
    """Write every partition of ``df`` as one archive (ids, vectors) below ``path``, which all executors must reach; (path, n_rows) of each.

    For exchange with programs that read NumPy files; within Spark :func:`treeloom.sources.sinks.save_vectors` is the better form.
    Each archive is put in place in one step under a name that a repeated task writes again.  Vectors that hold NaN or infinite numbers raise an error.
    """
    from pyspark import TaskContext

    target = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0), b.column(1)) for b in batches if b.num_rows]
        if not parts:
            return
        names = np.array([str(v) for k, _ in parts for v in k.to_pylist()])
        x = np.concatenate([v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for _, v in parts]).astype(np.float32)
        if not np.isfinite(x).all():
            raise ArrayError("a vector holds NaN or infinite numbers")
        held = io.BytesIO()
        np.savez_compressed(held, **{ids: names, vectors: x})
        system, root = fs.FileSystem.from_uri(target) if "://" in target and not target.startswith("file:") else (fs.LocalFileSystem(), "/" + target.removeprefix("file:").lstrip("/"))
        system.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        name, draft = f"{root}/part-{number:05}.npz", f"{root}/_part-{number:05}-{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(draft) as f:
            f.write(held.getbuffer())
        system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(x)])], ["path", "n_rows"])

    return df.select(F.col(key).cast("string"), F.col(vector).cast("array<float>")).mapInArrow(run, "path string, n_rows bigint")
