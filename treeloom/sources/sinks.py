"""Writers: vectors, predictions, partial sums, JSON, and manifests with checksums."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import os
import platform
import subprocess
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(x: object) -> object:
    """What ``json`` can't write by itself: anything with ``tolist`` (arrays and their numbers) or fields; the rest as text."""
    if hasattr(x, "tolist"):
        return x.tolist()
    if dataclasses.is_dataclass(x):
        return {f.name: getattr(x, f.name) for f in dataclasses.fields(x)}
    if isinstance(x, (set, frozenset)):
        return sorted(x, key=str)
    return str(x)


def jsonable(x: object) -> object:
    """``x`` as plain JSON values, by a round trip."""
    return json.loads(json.dumps(x, default=_plain))


def save_json(x: object, path: str) -> None:
    """Sorted keys, NaN and infinity refused, put in place in one step."""
    text = json.dumps(x, default=_plain, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, held = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text + "\n")
        os.replace(held, path)
    except BaseException:
        os.unlink(held)
        raise


def save_config(settings: dict, path: str, keep_metadata: bool = False) -> None:
    """Settings as JSON; what a loader noted about their origin under ``_metadata`` is dropped unless it is to be kept."""
    save_json(settings if keep_metadata else {k: v for k, v in settings.items() if k != "_metadata"}, path)


def save_vectors(df: DataFrame, path: str, vector: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned on request; refuses vectors that hold NaN or infinite numbers."""
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    checked = df.withColumn(vector, F.when(bad, F.raise_error(F.lit("a vector holds NaN or infinite numbers"))).otherwise(F.col(vector)))
    checked.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def predictions(assigned: DataFrame, labels: DataFrame, key: str, seeds: list[int]) -> DataFrame:
    """One row per document: key, labels and one column cluster_seed_<s> for each seed."""
    wide = assigned.groupBy(key).pivot("seed", seeds).agg(F.min("cluster"))
    return labels.join(wide.select(key, *[F.col(str(s)).alias(f"cluster_seed_{s}") for s in seeds]), key, "left")


def save_predictions(df: DataFrame, path: str, order: str) -> None:
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)


def save_clusterings(runs: list, path: str, mode: str = "errorifexists") -> None:
    """Runs of :func:`treeloom.operators.kmeans.run_seeds` as three tables below ``path``, each partitioned by seed.

    ``labels`` (row, cluster, similarity), ``centroids`` (cluster_id, count, centroid) and ``summary`` (objective, n_iterations, converged,
    active_clusters, max_share): what a later run needs to compare with or to start from.
    """
    for assigned, result in runs:
        spark = assigned.sparkSession
        centres = [(k, int(n), [float(v) for v in c]) for k, (n, c) in enumerate(zip(result.counts, result.centroids))]
        tables = {
            "labels": assigned,
            "centroids": spark.createDataFrame(centres, "cluster_id int, count bigint, centroid array<double>"),
            "summary": spark.createDataFrame([(float(result.objective), result.n_iterations, bool(result.converged), result.active_clusters, result.max_share)], "objective double, n_iterations int, converged boolean, active_clusters int, max_share double"),
        }
        for name, df in tables.items():
            df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}/seed={result.seed}")


def save_final(features: DataFrame, path: str, key: str, vector: str, config: object, mode: str = "errorifexists") -> None:
    """The final archive: vectors in order of their row numbers, and beside them a JSON file with the configuration and their number and length."""
    save_vectors(features.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select("row_idx", key, vector), f"{path}/features", vector, mode)
    told = features.sparkSession.read.parquet(f"{path}/features").agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    save_text(features.sparkSession, json.dumps({"config": jsonable(config), "n_rows": told["n"], "dim": told["dim"]}, sort_keys=True), f"{path}/metadata.json")


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on any file system Spark knows, put in place in one step."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    system, draft = target.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"could not write {path}")
    del jvm


def save_partials(partials: DataFrame, path: str, signature: str, sizes: DataFrame | None = None) -> None:
    """Partial sums by shard: writing a shard again replaces that shard alone.

    ``sizes`` (shard, source_size) records how large each shard's source was, so that a shard that changed is made anew.
    """
    if sizes is not None:
        partials = partials.join(F.broadcast(sizes.select("shard", "source_size")), "shard", "left")  # one row per shard file
    partials.withColumn("config_sig", F.lit(signature)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_sig", "shard").parquet(path)


def shards_to_do(shards: DataFrame, partials: DataFrame, signature: str) -> DataFrame:
    """Shards without a partial of this configuration, and - where ``shards`` and the partials have ``source_size`` - of this size."""
    by = ["shard", "source_size"] if "source_size" in shards.columns and "source_size" in partials.columns else ["shard"]
    done = partials.filter(F.col("config_sig") == signature).withColumn("shard", F.col("shard").cast("string")).select(*by).distinct()
    return shards.select(*by).distinct().join(done, by, "left_anti")


def config_signature(config: object) -> str:
    return json.dumps(jsonable(config), sort_keys=True, separators=(",", ":"))


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of every file below ``path``, hashed on the executors in blocks, so that a file may have any size."""
    from treeloom.sources.arrays import open_file
    from treeloom.sources.readers import list_files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with open_file(name) as f:
                    while block := f.read(1 << 22):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "length", "sha256"])

    return list_files(spark, path, pattern).select("path", "length").repartition("path").mapInArrow(run, "path string, length bigint, sha256 string")


def file_record(path: str) -> dict:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return {"path": os.path.abspath(path), "size": os.path.getsize(path), "sha256": digest.hexdigest()}


def environment(spark: SparkSession | None = None) -> dict:
    """Versions, platform and git state; git's are null where there is none."""

    def git(*args: str) -> str | None:
        try:
            out = subprocess.run(["git", *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.strip() if out.returncode == 0 else None

    status = git("status", "--porcelain")
    settings = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")} if spark else {}
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": pyspark.__version__, "numpy": np.__version__, "git_commit": git("rev-parse", "HEAD"), "git_dirty": None if status is None else bool(status), "spark_sql": settings}


def manifest(config: object, inputs: list[str], outputs: list[str], spark: SparkSession | None = None, **extra: object) -> dict:
    """Time, configuration, files (those that exist) and environment of a run."""
    records = lambda paths: [file_record(p) for p in paths if os.path.isfile(p)]
    return {"created_at": datetime.now(timezone.utc).isoformat(), "config": jsonable(config), "inputs": records(inputs), "outputs": records(outputs), "environment": environment(spark), **{k: jsonable(v) for k, v in extra.items()}}
