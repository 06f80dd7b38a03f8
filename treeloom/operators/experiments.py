"""Sweeps over pooling settings and numbers of clusters, splits by hash, and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.checks import norm_summary
from treeloom.operators.kmeans import run_seeds
from treeloom.operators.metrics import by_level, cluster_balance, seed_summary
from treeloom.operators.pooling import Pooling

#: The settings of the sensitivity table.
ROOT_WEIGHTS = (1.0, 2.0, 4.0, 8.0, 12.0, 16.0)
DEPTH_DECAYS = (0.0, 0.05, 0.10, 0.20)


def sensitivity_grid(**kw: object) -> list[Pooling]:
    return [Pooling(root_weight=a, depth_decay=d, **kw) for a in ROOT_WEIGHTS for d in DEPTH_DECAYS]


def uniform(key: str, seed: int):  # noqa: ANN201
    """A number in [0, 1) from md5(seed:key), the same on every engine and partitioning."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(2**32)


def tune_holdout(df: DataFrame, key: str, tune_share: float = 0.7, seed: int = 42) -> DataFrame:
    return df.withColumn("part", F.when(uniform(key, seed) < tune_share, "tune").otherwise("holdout"))


def best(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """The row with the highest metric, the smallest name among equals; null and NaN metrics are left out."""
    return df.filter(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(F.desc(metric), tie).limit(1)


def delta_to(df: DataFrame, metric: str, name: str, anchor: str) -> DataFrame:
    """Each row's distance of the metric from the anchor's row, which must be one."""
    base = df.filter(F.col(name) == anchor).select(F.col(metric).alias("_anchor"))
    return df.crossJoin(base).withColumn("delta", F.col(metric) - F.col("_anchor")).drop("_anchor")  # one row


def cluster_and_score(vectors: DataFrame, key: str, vector: str, labels: DataFrame, label_key: str, levels: tuple[str, ...], k: int, seeds: list[int], **kw: object) -> tuple[DataFrame, DataFrame]:
    """(scores by seed and level, summary over seeds) of spherical k-means against reference labels."""
    runs = run_seeds(vectors, key, vector, k, seeds, **kw)
    told = None
    for assigned, result in runs:
        one = assigned.select(F.col("row").alias(label_key), F.col("cluster"), F.lit(result.seed).alias("seed"))
        told = one if told is None else told.unionByName(one)
    scored = by_level(told.join(labels, label_key), levels, "cluster", ("seed",))
    return scored, seed_summary(scored)


def verify_outputs(vectors: DataFrame, vector: str, assigned: DataFrame, cluster: str, k: int, tolerance: float = 1e-5) -> DataFrame:
    """One row of checks on a run: equal row counts, finite unit vectors, all clusters in use, and whether all hold."""
    norms = norm_summary(vectors, vector)
    sizes = cluster_balance(assigned, cluster, k)
    both = norms.crossJoin(sizes)  # two single rows
    checks = {
        "same_rows": F.col("n_rows") == F.col("n"),
        "finite": F.col("n_invalid") == 0,
        "unit": F.coalesce(F.col("max_unit_error") <= tolerance, F.lit(False)),
        "all_active": F.col("active_clusters") == k,
    }
    told = both.select("n_rows", *[c.alias(name) for name, c in checks.items()])
    return told.withColumn("passed", F.expr(" and ".join(checks)))


def verify_grid(df: DataFrame, name: str, metric: str, grid: list[Pooling], anchor: str, expected: float, tolerance: float = 1e-10) -> DataFrame:
    """One row: whether each setting of the grid occurs once, the anchor's metric is as expected, and the best row."""
    names = df.sparkSession.createDataFrame([(g.name,) for g in grid], "_name string")
    missing = names.join(df, F.col("_name") == F.col(name), "left_anti").agg(F.count("*").alias("n_missing"))
    told = df.agg(F.count("*").alias("n"), F.countDistinct(name).alias("n_distinct"), F.max(F.when(F.col(name) == anchor, F.abs(F.col(metric) - expected))).alias("anchor_error"))
    top = best(df, metric, name).select(F.col(name).alias("best"), F.col(metric).alias("best_metric"))
    one = told.crossJoin(missing).crossJoin(top)  # single rows
    return one.withColumn("passed", (F.col("n") == F.col("n_distinct")) & (F.col("n") == len(grid)) & (F.col("n_missing") == 0) & (F.col("anchor_error") <= tolerance))
