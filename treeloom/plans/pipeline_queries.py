"""The whole chain at once: records, synthetic part vectors, pooling, reduction, clustering, scoring and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators import kmeans, records, reduction
from treeloom.operators.experiments import verify_outputs
from treeloom.operators.metrics import by_level
from treeloom.operators.pooling import Pooling, pool
from treeloom.plans.hierarchy_queries import PLACES
from treeloom.session import write_table
from treeloom.sources.synthetic import synthetic_vectors

DIM, REDUCED, K, SEED = 16, 4, 6, 42


def run(spark: SparkSession, sf_dir: str, p: Pooling = Pooling(unit_before=False, unit_after=False)) -> tuple[DataFrame, DataFrame, DataFrame, kmeans.KMeansResult]:
    """(normalised records, reduced vectors, assignments, result); records with cycles or without claims take no part."""
    rec = records.normalize_records(spark.read.parquet(f"{sf_dir}/demo_records.parquet"), with_text=False)
    deep = records.claim_depths(rec).withColumn("claim_pos", F.lit(0))
    parts = synthetic_vectors(deep, ["record_id", "claim_id"], DIM, SEED)
    pooled, _ = write_table(pool(parts, p, "record_id").select("record_id", "vector"), "pooled")
    reduced, _ = write_table(reduction.transform(pooled, "record_id", "vector", reduction.fit(pooled, REDUCED, "vector")).filter("reduced is not null"), "reduced")
    assigned, result = kmeans.spherical_kmeans(reduced, "record_id", "reduced", K, SEED, max_iter=50)
    return rec, reduced, assigned, result


def pipeline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the chain's outputs."""
    _, reduced, assigned, _ = run(spark, sf_dir)
    return verify_outputs(reduced, "reduced", assigned, "cluster", K)


def pipeline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the chain's clusters against the labels; the vectors are random, so they are near chance."""
    rec, _, assigned, _ = run(spark, sf_dir)
    return by_level(assigned.withColumnRenamed("row", "record_id").join(rec, "record_id"), ("section", "class", "subclass"), "cluster")


QUERIES = {"pipeline_checks": pipeline_checks, "pipeline_scores": pipeline_scores}
ORACLES = {
    "pipeline_checks": f"WITH RECURSIVE {PLACES} SELECT count(DISTINCT r) AS n_rows, true AS same_rows, true AS finite, true AS unit, true AS all_active, true AS passed FROM good",
}
