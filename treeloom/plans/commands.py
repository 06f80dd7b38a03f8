"""The jobs of the command line: prepare features, fit a reduction, evaluate clusterings, verify result tables."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.text import label
from treeloom.operators import checks, experiments, kmeans, metrics, pooling, records, reduction
from treeloom.session import begin_run, clear, write_table
from treeloom.sources import readers, sinks

LEVELS = ("section", "class", "subclass")


def prepare(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Token entries and legacy records to the final archive of pooled vectors, in the order of the records, with a report.

    ``strict`` refuses records and parts that don't fit together; else they are left out and counted.  With a ``reference`` archive the vectors are compared with it.
    """
    entries, legacy = spark.read.parquet(a.entries), spark.read.parquet(a.records)
    if a.strict:
        records.read_legacy(legacy, a.expected)
    p = pooling.Pooling(a.root_weight, a.depth_decay, a.selection, unit_before=not a.raw, unit_after=not a.raw)
    depths = pooling.record_depths(legacy)
    parts = pooling.part_vectors(entries)
    joined = checks.join_strict(parts, depths, ["patent_id", "claim_id"], "token vectors without a depth") if a.strict else parts.join(depths, ["patent_id", "claim_id"])
    pooled, _ = write_table(pooling.pool(joined, p), "pooled")
    documents = legacy.filter("patent_id is not null").select("patent_id").distinct()
    if a.strict:
        records.require_empty(pooling.missing_documents(documents, pooled), "documents without a vector")
    placed = checks.positions(documents.join(pooled.filter("vector is not null"), "patent_id", "left_semi"), "patent_id").join(pooled, "patent_id")
    config = {"pooling": p, "entries": a.entries, "records": a.records}
    sinks.save_final(placed.select("row_idx", "patent_id", "vector"), a.out, "patent_id", "vector", config, a.mode)
    saved = spark.read.parquet(f"{a.out}/features")
    report = {
        "config": config, "environment": sinks.environment(spark),
        "summary": pooling.accumulation_summary(documents, pooled).first().asDict(),
        "n_truncated": entries.filter("truncated").select("patent_id", "claim_id").distinct().count(),
        "n_without_depth": checks.unmatched(parts, depths, ["patent_id", "claim_id"]).count(),
        "norms": checks.norm_summary(saved, "vector").first().asDict(),
    }
    passed = True
    if a.reference:
        told = checks.compare_matrices(saved, spark.read.parquet(a.reference), "patent_id", "vector", most=a.most).first().asDict()
        report["reference"], passed = told, bool(told["passed"])
    sinks.save_text(spark, json.dumps(sinks.jsonable(report), sort_keys=True, indent=2), f"{a.out}/report.json")
    return passed or not a.require_match


def fit(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Fit a reduction on the vectors of an archive and save it."""
    units, _ = write_table(_features(spark, a.features), "units")
    reduction.fit(units, a.dim, "vector", a.whiten).save(a.out)
    return True


def _features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/features").select("row_idx", F.col("patent_id").cast("string").alias("patent_id"), "vector")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Cluster an archive's vectors, reduced by a saved model if one is given, with several seeds, score them against labels, and save everything.

    Passes if vectors are finite and of unit length, labels stand in the same order, all runs converge with all clusters in use, and - where
    ``expect_nmi`` is given - the mean NMI is that.
    """
    features, labels = _features(spark, a.features), spark.read.parquet(a.labels)
    labels = labels.select(F.col("global_index").alias("row_idx"), F.col("patent_id").alias("labelled_id"), *[label(c).alias(c) for c in LEVELS])
    both = checks.align_positions(features, labels, "row_idx", "features and labels")
    order = both.agg(F.count_if(~F.col("patent_id").eqNullSafe(F.col("labelled_id"))).alias("n")).first()["n"] if a.check_order else 0
    vectors = features.select("row_idx", "vector")
    if a.model:
        vectors = reduction.transform(vectors, "row_idx", "vector", reduction.Reduction.load(a.model)).select("row_idx", F.col("reduced").alias("vector"))
    vectors, _ = write_table(vectors, "vectors")
    norms = checks.norm_summary(vectors, "vector").first()
    runs = kmeans.run_seeds(vectors, "row_idx", "vector", a.k, a.seeds, a.max_iter, a.tolerance, legacy=True)
    told = None
    for assigned, result in runs:
        one = assigned.select(F.col("row").alias("row_idx"), "cluster", F.lit(result.seed).alias("seed"))
        told = one if told is None else told.unionByName(one)
    told, _ = write_table(told, "assigned")
    scored = metrics.by_level(told.join(labels, "row_idx"), LEVELS, "cluster", ("seed",))
    summary = metrics.seed_summary(scored).collect()
    sinks.save_clusterings(runs, f"{a.out}/clusterings", a.mode)
    wide = sinks.predictions(told, labels.withColumnRenamed("labelled_id", "patent_id"), "row_idx", a.seeds)
    sinks.save_predictions(wide, f"{a.out}/predictions", "row_idx")
    mean = {r["metric"]: r["mean"] for r in summary if r["level"] == "mean"}
    gates = {
        "order": order == 0, "finite": norms["n_invalid"] == 0, "unit": norms["max_unit_error"] is not None and norms["max_unit_error"] <= 1e-5,
        "converged": all(r.converged for _, r in runs), "all_active": all(r.active_clusters == a.k for _, r in runs),
        "nmi": a.expect_nmi is None or abs(mean["nmi_arithmetic"] - a.expect_nmi) <= a.nmi_tolerance,
    }
    report = {
        "gates": gates, "passed": all(gates.values()), "k": a.k, "environment": sinks.environment(spark),
        "seeds": [{"seed": r.seed, "objective": r.objective, "n_iterations": r.n_iterations, "converged": r.converged, "active_clusters": r.active_clusters, "max_share": r.max_share} for _, r in runs],
        "summary": [r.asDict() for r in summary],
        "files": [r.asDict() for r in sinks.checksums(spark, f"{a.out}/predictions", "*.csv").orderBy("path").collect()],
    }
    sinks.save_text(spark, json.dumps(sinks.jsonable(report), sort_keys=True, indent=2), f"{a.out}/report.json")
    return report["passed"]


def verify(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Whether a result table in CSV has every setting of the sensitivity grid once, and its anchor the expected metric."""
    table = readers.read_results(spark, a.results).withColumn(a.metric, F.col(a.metric).cast("double"))
    told = experiments.verify_grid(table, a.name, a.metric, experiments.sensitivity_grid(), a.anchor, a.expected, a.tolerance).first()
    print(json.dumps(told.asDict()))
    return bool(told["passed"])


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m treeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(run: Callable[[SparkSession, argparse.Namespace], bool], *required: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(run.__name__, help=(run.__doc__ or "").splitlines()[0])
        sub.set_defaults(run=run)
        for name in required:
            sub.add_argument(f"--{name}", required=True)
        return sub

    modes = ("errorifexists", "overwrite")
    p = command(prepare, "entries", "records", "out")
    p.add_argument("--root-weight", type=float, default=12.0)
    p.add_argument("--depth-decay", type=float, default=0.1)
    p.add_argument("--selection", choices=pooling.SELECTIONS, default="all")
    p.add_argument("--raw", action="store_true", help="no unit vectors before and after pooling")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--expected", type=int)
    p.add_argument("--reference")
    p.add_argument("--most", type=float)
    p.add_argument("--require-match", action="store_true")
    p.add_argument("--mode", choices=modes, default=modes[0])
    p = command(fit, "features", "out")
    p.add_argument("--dim", type=int, default=128)
    p.add_argument("--whiten", action="store_true")
    p = command(evaluate, "features", "labels", "out")
    p.add_argument("--model")
    p.add_argument("--k", type=int, default=30)
    p.add_argument("--seeds", type=int, nargs="+", default=[17, 42, 73])
    p.add_argument("--max-iter", type=int, default=100)
    p.add_argument("--tolerance", type=float, default=1e-5)
    p.add_argument("--check-order", action="store_true")
    p.add_argument("--expect-nmi", type=float)
    p.add_argument("--nmi-tolerance", type=float, default=1e-9)
    p.add_argument("--mode", choices=modes, default=modes[0])
    p = command(verify, "results", "anchor")
    p.add_argument("--expected", type=float, required=True)
    p.add_argument("--name", default="pool")
    p.add_argument("--metric", default="mean_nmi")
    p.add_argument("--tolerance", type=float, default=1e-10)
    return parser


def main(spark: SparkSession, args: list[str]) -> int:
    """0 if the job's checks pass, else 1.  The job's intermediates are deleted at its end."""
    a = _parser().parse_args(args)
    folder = begin_run(spark, a.command)
    try:
        return 0 if a.run(spark, a) else 1
    finally:
        clear(spark, folder)
