"""Vectors, reduction, k-means, metrics and checks over patent_features, patent_labels and the older k-means run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.text import label
from treeloom.functions.vectors import dot
from treeloom.operators import checks, kmeans, metrics, reduction
from treeloom.operators.experiments import best, cluster_and_score, delta_to
from treeloom.session import write_table
from treeloom.sources.sinks import predictions

LEVELS = ("section", "class", "subclass")
K = 30


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """Unit vectors; ``keep`` writes them, for loops and for queries that read them several times."""
    units = kmeans.unit_rows(_table(spark, sf_dir, "patent_features"), "row_idx", "features")
    return write_table(units, "units")[0] if keep else units


def _r(c, digits: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, digits) + F.lit(0.0)


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older run, one row per seed and row; of repeated rows with differing labels the smallest."""
    return _table(spark, sf_dir, "kmeans_assignments").groupBy("seed", "row_idx").agg(F.min("label").alias("label"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "patent_labels").select(F.col("global_index").alias("row_idx"), *[F.upper(label(c)).alias(c) for c in LEVELS])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_level(_old(spark, sf_dir).join(_labels(spark, sf_dir), "row_idx"), LEVELS, "label", ("seed",))


def _score_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *[_r(F.col(c)).alias(c) for c in ("purity", "inverse_purity", "ari", *(f"nmi_{a}" for a in metrics.AVERAGES))])


def l2_norm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checks.norm_summary(_table(spark, sf_dir, "patent_features"), "features")
    return out.select("n_rows", "n_invalid", *[_r(F.col(c)).alias(c) for c in ("min_norm", "mean_norm", "max_norm", "max_unit_error")])


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each valid vector with the next row's."""
    u = _units(spark, sf_dir)
    nxt = u.select((F.col("row") - 1).alias("row"), F.col("v").alias("w"))
    return u.join(nxt, "row").select(F.col("row").alias("row_idx"), _r(dot(F.col("v"), F.col("w"))).alias("cosine"))


def pca_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mean, _ = reduction.moments(_units(spark, sf_dir))
    out = spark.createDataFrame([(i, float(x)) for i, x in enumerate(mean)], "dim bigint, mean double")
    return out.select("dim", _r(F.col("mean")).alias("mean"))


def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cov = reduction.moments(_units(spark, sf_dir))
    out = spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))], "i bigint, j bigint, cov double")
    return out.select("i", "j", _r(F.col("cov"), 8).alias("cov"))


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight centred components of each row, scaled to unit length."""
    u = _units(spark, sf_dir, keep=True)
    return reduction.transform(u, "row", "v", reduction.fit(u, 8)).withColumnRenamed("row", "row_idx")


def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product of each row's projection on all components with the next row's: what no sign or order of components changes."""
    u = _units(spark, sf_dir, keep=True)
    model = reduction.fit(u, len(u.first()["v"]))
    reduced, _ = write_table(reduction.transform(u, "row", "v", model), "reduced")
    nxt = reduced.select((F.col("row") - 1).alias("row"), F.col("reduced").alias("w"))
    return reduced.join(nxt, "row").select(F.col("row").alias("row_idx"), _r(dot(F.col("reduced"), F.col("w"))).alias("cosine"))


def pca_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on 16 components: whole variance, and what must hold of components, variances and projections, whitened ones too."""
    u = _units(spark, sf_dir, keep=True)
    n, mean, cov = reduction.moments(u)
    plain, white = reduction.fit(u, 16), reduction.fit(u, 16, whiten=True)
    full = reduction.fit(u, len(mean))
    c = plain.components
    told = {
        "orthonormal": np.abs(c @ c.T - np.eye(16)).max() < 1e-9,
        "eigenvectors": np.abs(cov @ c.T - c.T * plain.variances).max() < 1e-9,
        "falling": bool((np.diff(plain.variances) <= 1e-15).all()),
        "shares_add_up": abs(full.explained.sum() - 1) < 1e-9 and np.allclose(full.explained[:16], plain.explained),
        "signs_fixed": bool((c[np.arange(16), np.abs(c).argmax(axis=1)] > 0).all()),
    }
    _, m0, c0 = reduction.moments(reduction.transform(u, "row", "v", plain, unit=False), "reduced")
    _, _, c1 = reduction.moments(reduction.transform(u, "row", "v", white, unit=False), "reduced")
    told |= {"projected_variances": np.abs(m0).max() < 1e-9 and np.abs(c0 - np.diag(plain.variances)).max() < 1e-9, "white": np.abs(c1 - np.eye(16)).max() < 1e-6}
    norms = checks.norm_summary(reduction.transform(u, "row", "v", plain), "reduced").first()
    told["unit"] = norms["n_invalid"] == 0 and norms["max_unit_error"] < 1e-9
    names = list(told)
    return spark.createDataFrame([(n, round(float(np.trace(cov)), 6), *[bool(told[k]) for k in names])], f"n_rows bigint, total_variance double, {', '.join(f'{k} boolean' for k in names)}")


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = reduction.fit(_units(spark, sf_dir), 16)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(model.explained)], "component bigint, share double")


def kmeans_assign_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows assigned to the older run's centroids of seed 42."""
    c = kmeans.centroid_rows(_table(spark, sf_dir, "kmeans_centroids").filter("seed = 42"))
    return kmeans.assign(_units(spark, sf_dir), c).select(F.col("row").alias("row_idx"), "cluster", _r(F.col("similarity")).alias("similarity"))


def _first_rows(u: DataFrame, k: int) -> np.ndarray:
    return np.array([r["v"] for r in u.orderBy("row").limit(k).collect()])


def kmeans_lloyd_3iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Lloyd steps from the first ten rows, then the assignment."""
    u = _units(spark, sf_dir, keep=True)
    result = kmeans.lloyd(u, _first_rows(u, 10), max_iter=3, tolerance=0.0)
    return kmeans.assign(u, result.centroids).select(F.col("row").alias("row_idx"), "cluster", _r(F.col("similarity")).alias("similarity"))


def kmeans_empty_reseed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Lloyd steps from the first five rows given twice: the second five are empty and take the least similar rows."""
    u = _units(spark, sf_dir, keep=True)
    first = _first_rows(u, 5)
    result = kmeans.lloyd(u, np.concatenate((first, first)), max_iter=2, tolerance=0.0)
    return kmeans.assign(u, result.centroids).select(F.col("row").alias("row_idx"), "cluster", _r(F.col("similarity")).alias("similarity"))


def kmeans_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of seeded runs with K = 30 by either stop rule: counts, centroids, objective, labels, and the same draws for the same seed."""
    rows = []
    table = _table(spark, sf_dir, "patent_features")
    units = _units(spark, sf_dir, keep=True)
    for legacy in (False, True):
        ((assigned, r),) = kmeans.run_seeds(table, "row_idx", "features", K, [42], max_iter=100, tolerance=1e-5, legacy=legacy)
        centres = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(r.centroids)], "k int, c array<double>")
        near = units.crossJoin(F.broadcast(centres)).select("row", "k", dot(F.col("v"), F.col("c")).alias("s")).groupBy("row").agg(F.max("s").alias("s"))  # K centroids
        told = assigned.join(near, "row").join(F.broadcast(centres), F.col("cluster") == F.col("k")).join(units, "row").agg(
            F.count("*").alias("n"), F.avg(1 - F.col("s")).alias("objective"), F.max(F.col("s") - dot(F.col("v"), F.col("c"))).alias("behind"), F.countDistinct("cluster").alias("active")
        ).first()
        again = kmeans.plus_plus(units, 5, 42, 1e-8 if legacy else 0.0)
        rows.append((legacy, told["n"], bool(r.counts.sum() == told["n"]), bool(np.abs(np.linalg.norm(r.centroids, axis=1) - 1).max() < 1e-9), abs(told["objective"] - r.objective) < 1e-9, told["behind"] < 1e-12, told["active"] == r.active_clusters, bool((again == kmeans.plus_plus(units.repartition(3), 5, 42, 1e-8 if legacy else 0.0)).all())))
    return spark.createDataFrame(rows, "legacy boolean, n_rows bigint, counts_fit boolean, unit_centroids boolean, objective_fits boolean, labels_nearest boolean, active_fits boolean, same_draws boolean")


def kmeans_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded spherical k-means with K = 30."""
    assigned, _ = kmeans.spherical_kmeans(_table(spark, sf_dir, "patent_features"), "row_idx", "features", K, seed=42, max_iter=100, tolerance=1e-5)
    return assigned.withColumnRenamed("row", "row_idx")


def kmeans_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective, steps, convergence, active clusters and greatest share for three seeds."""
    runs = kmeans.run_seeds(_table(spark, sf_dir, "patent_features"), "row_idx", "features", K, [17, 42, 73], max_iter=100, tolerance=1e-5, legacy=True)
    return spark.createDataFrame([(r.seed, float(r.objective), r.n_iterations, r.converged, r.active_clusters, r.max_share) for _, r in runs], "seed int, objective double, n_iterations int, converged boolean, active_clusters int, max_share double")


def kmeans_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New clusterings with three seeds, scored against the labels and summed up over the seeds."""
    _, summary = cluster_and_score(_table(spark, sf_dir, "patent_features"), "row_idx", "features", _labels(spark, sf_dir), "row_idx", LEVELS, K, [17, 42, 73], max_iter=100, tolerance=1e-5)
    return summary


def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective, active clusters and greatest share for K from 20 to 40, from one row of draws: the draws for a smaller K begin those for a larger."""
    u = _units(spark, sf_dir, keep=True)
    drawn, rows = kmeans.plus_plus(u, 40, 42), []
    for k in (20, 25, 30, 35, 40):
        r = kmeans.lloyd(u, drawn[:k], max_iter=100, tolerance=1e-5, seed=42)
        rows.append((k, float(r.objective), r.active_clusters, r.max_share))
    return spark.createDataFrame(rows, "k int, objective double, active_clusters int, max_share double")


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _old(spark, sf_dir).join(_labels(spark, sf_dir), "row_idx")
    return metrics.contingency(df, "section", "label", ("seed",))


def level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purity, inverse purity, adjusted Rand index and NMI by all averages, for each seed and label level."""
    return _score_columns(_scored(spark, sf_dir), "seed", "level")


def source_language_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores of documents' languages against their sources."""
    docs = _table(spark, sf_dir, "documents")
    return _score_columns(metrics.scores(metrics.contingency(docs, "lang", "source")))


def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.seed_summary(_scored(spark, sf_dir)).select("level", "metric", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed with the highest mean NMI, and its distance to seed 42."""
    each = _scored(spark, sf_dir).groupBy("seed").agg(_r(F.avg("nmi_arithmetic")).alias("mean_nmi"))
    return best(delta_to(each, "mean_nmi", "seed", 42), "mean_nmi", "seed").select("seed", "mean_nmi", _r(F.col("delta")).alias("delta"))


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the older run against the nearest of its own centroids, seed 42."""
    new = kmeans_assign_fixed(spark, sf_dir).select("row_idx", "cluster")
    old = _old(spark, sf_dir).filter("seed = 42").select("row_idx", F.col("label").cast("bigint").alias("label"))
    out = metrics.label_match(old.join(new, "row_idx"), "label", "cluster")
    return out.select("n", "n_equal", "n_unequal", *[_r(F.col(c)).alias(c) for c in ("match_rate", "ari", "nmi")])


def cluster_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_balance(_old(spark, sf_dir), "label", K, ("seed",)).select("seed", "active_clusters", _r(F.col("max_share")).alias("max_share"), "n", "k")


def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective, active clusters and greatest share of the older run, mean and deviation over its seeds."""
    old = _table(spark, sf_dir, "kmeans_assignments").groupBy("seed", "row_idx").agg(F.min("label").alias("label"), F.min("similarity").alias("similarity"))
    return metrics.run_summary(old, "label", "similarity").select("metric", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patent_labels against patent_features by patent_id, and against demo_records, in order of record_id, by section, class and subclass."""
    feats = _table(spark, sf_dir, "patent_features").filter("row_idx is not null").groupBy("row_idx").agg(F.min("patent_id").alias("patent_id"))
    labels = _table(spark, sf_dir, "patent_labels")
    records = _table(spark, sf_dir, "demo_records").filter("record_id is not null").groupBy("record_id").agg(*[F.min(F.upper(label(f"cpc.{c}"))).alias(c) for c in LEVELS])
    numbered = records.join(checks.positions(records, "record_id"), "record_id")
    by_level = checks.alignment(_labels(spark, sf_dir), numbered, "row_idx", "row_idx", list(LEVELS))
    return checks.alignment(labels.select("global_index", "patent_id"), feats, "global_index", "row_idx", ["patent_id"]).unionByName(by_level)


def index_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.index_is_complete(_table(spark, sf_dir, "patent_labels"), "global_index")


def matrix_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as stored against their unit form."""
    stored = _table(spark, sf_dir, "patent_features").filter("row_idx is not null").groupBy("row_idx").agg(F.min("features").alias("v"))
    fine = _units(spark, sf_dir, keep=True).withColumnRenamed("row", "row_idx")
    out = checks.compare_matrices(stored, fine, "row_idx", "v", atol=1e-3, rtol=1e-3)
    clean = checks.compare_matrices(fine, fine, "row_idx", "v")
    one = lambda df, name: df.select(F.lit(name).alias("pair"), "n_rows", "n_left_only", "n_right_only", "n_misfits", *[_r(F.col(c)).alias(c) for c in ("min_cosine", "max_difference", "p99_difference")], "all_equal", "passed")
    return one(out, "stored").unionByName(one(clean, "same"))


def predictions_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _old(spark, sf_dir).withColumnRenamed("label", "cluster")
    return predictions(assigned, _labels(spark, sf_dir), "row_idx", [17, 42, 73])


def manifest_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of every document's text, and its number of bytes."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


_U = """
f AS (SELECT row_idx, min(features) AS v FROM patent_features WHERE row_idx IS NOT NULL AND features IS NOT NULL AND len(features) > 0 AND NOT list_bool_or(list_transform(features, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
      AND sqrt(list_sum(list_transform(features, lambda x: x::DOUBLE * x::DOUBLE))) > 1e-12 GROUP BY row_idx),
u AS (SELECT row_idx, list_transform(v, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM f)"""
_OLD = f"o AS (SELECT seed, row_idx, min(label) AS label FROM kmeans_assignments GROUP BY 1, 2), y AS (SELECT global_index AS row_idx, {', '.join(f'''upper(nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)), '')) AS {c}''' for c in LEVELS)} FROM patent_labels)"


def _score_sql(cells: str, keys: list[str]) -> str:
    """SQL for all scores from a relation ``cells``(keys, truth, predicted, n)."""
    k = ", ".join(keys) + ", " if keys else ""
    g = f"GROUP BY {', '.join(keys)}" if keys else ""
    using = f"JOIN rt USING ({', '.join(keys)}) JOIN ct USING ({', '.join(keys)})" if keys else ", rt, ct"
    return f"""
r1 AS (SELECT {k}truth, sum(n)::DOUBLE AS n, max(n) AS top FROM {cells} GROUP BY {k}truth),
c1 AS (SELECT {k}predicted, sum(n)::DOUBLE AS n, max(n) AS top FROM {cells} GROUP BY {k}predicted),
rt AS (SELECT {k}sum(n * (n - 1) / 2) AS pr, sum(n * ln(n)) AS lr, sum(top) AS tr FROM r1 {g}),
ct AS (SELECT {k}sum(n * (n - 1) / 2) AS pc, sum(n * ln(n)) AS lc, sum(top) AS tc FROM c1 {g}),
z0 AS (SELECT {k}sum(n::DOUBLE * (n - 1) / 2) AS pz, sum(n::DOUBLE * ln(n::DOUBLE)) AS lz, sum(n)::DOUBLE AS t FROM {cells} {g}),
z AS (SELECT *, ln(t) - lr / t AS ht, ln(t) - lc / t AS hp, ln(t) + (lz - lr - lc) / t AS mi, pr * pc / (t * (t - 1) / 2) AS ex FROM z0 {using}),
score AS (SELECT {k}t::BIGINT AS n, round(tc / t, 6) + 0.0 AS purity, round(tr / t, 6) + 0.0 AS inverse_purity, round((pz - ex) / ((pr + pc) / 2 - ex), 6) + 0.0 AS ari,
 round(mi / ((ht + hp) / 2), 6) + 0.0 AS nmi_arithmetic, round(mi / sqrt(ht * hp), 6) + 0.0 AS nmi_geometric, round(mi / least(ht, hp), 6) + 0.0 AS nmi_min, round(mi / greatest(ht, hp), 6) + 0.0 AS nmi_max, mi / ((ht + hp) / 2) AS raw_nmi, tc / t AS raw_p, tr / t AS raw_i FROM z)"""


_LEVEL_CELLS = f"{_OLD}, j AS (SELECT seed, label, unnest(['section', 'class', 'subclass']) AS level, unnest([section, class, subclass]) AS truth FROM o JOIN y USING (row_idx)), cells AS (SELECT seed, level, truth, label AS predicted, count(*) AS n FROM j WHERE truth IS NOT NULL AND label IS NOT NULL GROUP BY ALL)"
_LEVEL = f"WITH {_LEVEL_CELLS}, {_score_sql('cells', ['seed', 'level'])}"
_SHOWN = "n, purity, inverse_purity, ari, nmi_arithmetic, nmi_geometric, nmi_min, nmi_max"
_FIXED = f"""{_U}, c AS (SELECT cluster_id AS k, list_transform(centroid, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(centroid, lambda y: y::DOUBLE * y::DOUBLE)))) AS c FROM kmeans_centroids WHERE seed = 42),
s AS (SELECT row_idx, k, list_dot_product(v, c) AS s FROM u, c), b AS (SELECT row_idx, k::BIGINT AS cluster, s, row_number() OVER (PARTITION BY row_idx ORDER BY s DESC, k) AS rn FROM s)"""


def _lloyd_sql(k: int, steps: int) -> str:
    out = f"WITH {_U}, c0 AS (SELECT row_number() OVER (ORDER BY row_idx) - 1 AS k, v AS c FROM u ORDER BY row_idx LIMIT {k})"
    for i in range(steps + 1):
        out += f", s{i} AS (SELECT row_idx, k, list_dot_product(v, c) AS s FROM u, c{i}), b{i} AS (SELECT row_idx, k, s FROM (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY s DESC, k) AS rn FROM s{i}) WHERE rn = 1)"
        if i < steps:
            out += f", e{i} AS (SELECT k, unnest(range(len(v))) AS d, unnest(v) AS x FROM b{i} JOIN u USING (row_idx)), m{i} AS (SELECT k, d, sum(x) AS x FROM e{i} GROUP BY 1, 2), c{i + 1} AS (SELECT k, list(x / n ORDER BY d) AS c FROM m{i} JOIN (SELECT k, sqrt(sum(x * x)) AS n FROM m{i} GROUP BY 1) USING (k) GROUP BY 1 UNION ALL SELECT z.k, u.v FROM (SELECT k, row_number() OVER (ORDER BY k) AS rn FROM c{i} WHERE k NOT IN (SELECT k FROM b{i})) z JOIN (SELECT row_idx, row_number() OVER (ORDER BY s, row_idx) AS rn FROM b{i}) w USING (rn) JOIN u USING (row_idx))"
    return out + f" SELECT row_idx, k::BIGINT AS cluster, round(s, 6) + 0.0 AS similarity FROM b{steps}"


QUERIES = {
    f.__name__: f
    for f in (l2_norm_summary, cosine_pairs, pca_mean, pca_covariance, pca_projection, pca_gram, pca_checks, pca_explained, kmeans_empty_reseed, kmeans_checks, run_overview, kmeans_assign_fixed, kmeans_lloyd_3iter, kmeans_seeded, kmeans_summary, kmeans_scored, k_sweep, contingency, level_metrics, source_language_metrics, seed_summary, best_config, label_match, cluster_balance, alignment_report, index_complete, matrix_compare, predictions_pivot, manifest_checksums)
}
ORACLES = {
    "l2_norm_summary": """WITH n AS (SELECT CASE WHEN features IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(features, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false) THEN sqrt(list_sum(list_transform(features, lambda x: x::DOUBLE * x::DOUBLE))) END AS n FROM patent_features)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n IS NULL) AS n_invalid, round(min(n), 6) + 0.0 AS min_norm, round(avg(n), 6) + 0.0 AS mean_norm, round(max(n), 6) + 0.0 AS max_norm, round(max(abs(n - 1)), 6) + 0.0 AS max_unit_error FROM n""",
    "cosine_pairs": f"WITH {_U} SELECT a.row_idx, round(list_dot_product(a.v, b.v), 6) + 0.0 AS cosine FROM u a JOIN u b ON b.row_idx = a.row_idx + 1",
    "pca_mean": f"WITH {_U}, l AS (SELECT unnest(range(len(v))) AS dim, unnest(v) AS x FROM u) SELECT dim, round(avg(x), 6) + 0.0 AS mean FROM l GROUP BY 1",
    "pca_covariance": f"WITH {_U}, l AS (SELECT row_idx, unnest(range(len(v))) AS d, unnest(v) AS x FROM u) SELECT a.d AS i, b.d AS j, round(covar_samp(a.x, b.x), 8) + 0.0 AS cov FROM l a JOIN l b USING (row_idx) GROUP BY 1, 2",
    "kmeans_assign_fixed": f"WITH {_FIXED} SELECT row_idx, cluster, round(s, 6) + 0.0 AS similarity FROM b WHERE rn = 1",
    "kmeans_lloyd_3iter": _lloyd_sql(10, 3),
    "kmeans_empty_reseed": _lloyd_sql(10, 2).replace("SELECT row_number() OVER (ORDER BY row_idx) - 1 AS k, v AS c FROM u ORDER BY row_idx LIMIT 10", "SELECT k + 5 * h AS k, v AS c FROM (SELECT row_number() OVER (ORDER BY row_idx) - 1 AS k, v FROM u ORDER BY row_idx LIMIT 5), (VALUES (0), (1)) AS t(h)"),
    "kmeans_checks": f"WITH {_U} SELECT legacy, (SELECT count(*) FROM u) AS n_rows, true AS counts_fit, true AS unit_centroids, true AS objective_fits, true AS labels_nearest, true AS active_fits, true AS same_draws FROM (VALUES (false), (true)) AS t(legacy)",
    "pca_gram": f"""WITH {_U}, l AS (SELECT row_idx, unnest(range(len(v))) AS d, unnest(v) AS x FROM u), m AS (SELECT d, avg(x) AS m FROM l GROUP BY 1), z AS (SELECT row_idx, list(x - m ORDER BY d) AS z FROM l JOIN m USING (d) GROUP BY 1)
SELECT a.row_idx, round(list_cosine_similarity(a.z, b.z), 6) + 0.0 AS cosine FROM z a JOIN z b ON b.row_idx = a.row_idx + 1""",
    "pca_checks": f"""WITH {_U}, l AS (SELECT unnest(range(len(v))) AS d, unnest(v) AS x FROM u), t AS (SELECT sum(s) AS t FROM (SELECT var_samp(x) AS s FROM l GROUP BY d))
SELECT (SELECT count(*) FROM u) AS n_rows, round(t, 6) + 0.0 AS total_variance, {', '.join(f'true AS {c}' for c in ('orthonormal', 'eigenvectors', 'falling', 'shares_add_up', 'signs_fixed', 'projected_variances', 'white', 'unit'))} FROM t""",
    "run_overview": """WITH o AS (SELECT seed, row_idx, min(label) AS label, min(similarity)::DOUBLE AS s FROM kmeans_assignments GROUP BY 1, 2), z AS (SELECT seed, label, count(*) AS n FROM o WHERE label IS NOT NULL GROUP BY 1, 2),
b AS (SELECT seed, count(*)::DOUBLE AS a, max(n) / sum(n) AS m FROM z GROUP BY 1), j AS (SELECT seed, avg(1 - s) AS ob FROM o GROUP BY 1),
l AS (SELECT unnest(['objective', 'active_clusters', 'max_share']) AS metric, unnest([ob, a, m]) AS v FROM b JOIN j USING (seed)) SELECT metric, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std FROM l GROUP BY 1""",
    "contingency": f"WITH {_OLD} SELECT seed, section AS truth, label::VARCHAR AS predicted, count(*) AS n FROM o JOIN y USING (row_idx) WHERE section IS NOT NULL AND label IS NOT NULL GROUP BY ALL",
    "level_metrics": f"{_LEVEL} SELECT seed, level, {_SHOWN} FROM score",
    "source_language_metrics": f"WITH cells AS (SELECT lang AS truth, source AS predicted, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), {_score_sql('cells', [])} SELECT {_SHOWN} FROM score",
    "seed_summary": f"""{_LEVEL}, q AS (SELECT seed, level, unnest(['nmi_arithmetic', 'purity', 'inverse_purity']) AS metric, unnest([raw_nmi, raw_p, raw_i]) AS v FROM score),
a AS (SELECT * FROM q UNION ALL SELECT seed, 'mean', metric, avg(v) FROM q GROUP BY seed, metric) SELECT level, metric, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std FROM a GROUP BY 1, 2""",
    "best_config": f"{_LEVEL}, q AS (SELECT seed, round(avg(raw_nmi), 6) + 0.0 AS mean_nmi FROM score GROUP BY 1) SELECT seed, mean_nmi, round(mean_nmi - (SELECT mean_nmi FROM q WHERE seed = 42), 6) + 0.0 AS delta FROM q ORDER BY mean_nmi DESC, seed LIMIT 1",
    "label_match": f"""WITH {_FIXED}, {_OLD}, m AS (SELECT label, cluster, label IS NOT DISTINCT FROM cluster AS same FROM (SELECT * FROM o WHERE seed = 42) JOIN (SELECT * FROM b WHERE rn = 1) USING (row_idx)),
cells AS (SELECT label AS truth, cluster AS predicted, count(*) AS n FROM m WHERE label IS NOT NULL GROUP BY 1, 2), {_score_sql("cells", [])}, q AS (SELECT count(*) AS n, count(*) FILTER (WHERE same) AS n_equal, count(*) FILTER (WHERE NOT same) AS n_unequal, round(count(*) FILTER (WHERE same) / count(*), 6) + 0.0 AS match_rate FROM m)
SELECT q.*, score.ari AS ari, score.nmi_arithmetic AS nmi FROM q, score""",
    "cluster_balance": f"WITH {_OLD}, s AS (SELECT seed, label, count(*) AS n FROM o WHERE label IS NOT NULL GROUP BY 1, 2) SELECT seed, count(*) AS active_clusters, round(max(n) / sum(n), 6) + 0.0 AS max_share, sum(n)::BIGINT AS n, 30::BIGINT AS k FROM s GROUP BY 1",
    "alignment_report": f"""WITH {_OLD}, f AS (SELECT row_idx, min(patent_id) AS patent_id FROM patent_features WHERE row_idx IS NOT NULL GROUP BY 1), j AS (SELECT a.global_index AS a, b.row_idx AS b, a.patent_id AS x, b.patent_id AS y FROM patent_labels a FULL JOIN f b ON a.global_index = b.row_idx)
SELECT 'patent_id' AS "column", count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND x IS DISTINCT FROM y) AS n_unequal, count(*) FILTER (WHERE b IS NULL) AS n_left_only, count(*) FILTER (WHERE a IS NULL) AS n_right_only FROM j
UNION ALL SELECT c, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND x IS DISTINCT FROM y), count(*) FILTER (WHERE b IS NULL), count(*) FILTER (WHERE a IS NULL) FROM (
 SELECT y.row_idx AS a, d.row_idx AS b, unnest(['section', 'class', 'subclass']) AS c, unnest([y.section, y.class, y.subclass]) AS x, unnest([d.section, d.class, d.subclass]) AS y FROM y FULL JOIN (
  SELECT row_number() OVER (ORDER BY record_id) - 1 AS row_idx, * FROM (SELECT record_id, {', '.join(f'''upper(nullif(trim(min(cpc.{c}), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)), '')) AS {c}''' for c in LEVELS)} FROM demo_records WHERE record_id IS NOT NULL GROUP BY record_id)) d ON d.row_idx = y.row_idx) GROUP BY c""",
    "matrix_compare": f"""WITH {_U}, s AS (SELECT row_idx, min(features)::DOUBLE[] AS v FROM patent_features WHERE row_idx IS NOT NULL GROUP BY 1),
j AS (SELECT 'stored' AS pair, row_idx, s.v AS a, u.v AS b, 1e-3::DOUBLE AS tol, 1e-3::DOUBLE AS rel FROM s FULL JOIN u USING (row_idx) UNION ALL SELECT 'same', row_idx, v, v, 1e-6::DOUBLE, 1e-5::DOUBLE FROM u),
k AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND len(a) = len(b) AS fits FROM j),
r AS (SELECT pair, count(*) FILTER (WHERE fits) AS n_rows, count(*) FILTER (WHERE b IS NULL) AS n_left_only, count(*) FILTER (WHERE a IS NULL) AS n_right_only, count(*) FILTER (WHERE NOT fits AND a IS NOT NULL AND b IS NOT NULL) AS n_misfits,
 min(CASE WHEN fits THEN list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-12) END) AS c FROM k GROUP BY 1),
x AS (SELECT pair, tol, rel, unnest(a) AS a, unnest(b) AS b FROM k WHERE fits), d AS (SELECT pair, max(abs(a - b)) AS m, quantile_cont(abs(a - b), 0.99) AS p, bool_and(abs(a - b) <= tol + rel * abs(b)) AS close, bool_and(a = b) AS same FROM x GROUP BY 1)
SELECT pair, n_rows, n_left_only, n_right_only, n_misfits, round(c, 6) + 0.0 AS min_cosine, round(m, 6) + 0.0 AS max_difference, round(p, 6) + 0.0 AS p99_difference, same AS all_equal, close AND c >= 0.99999 AND n_left_only + n_right_only + n_misfits = 0 AS passed FROM r JOIN d USING (pair)""",
    "index_complete": "SELECT count(*) AS n, count(DISTINCT global_index) AS n_distinct, min(global_index) AS least, max(global_index) AS most, count(*) = count(DISTINCT global_index) AND min(global_index) = 0 AND max(global_index) = count(*) - 1 AS complete FROM patent_labels",
    "predictions_pivot": f"WITH {_OLD} SELECT y.*, {', '.join(f'(SELECT label FROM o WHERE o.row_idx = y.row_idx AND seed = {s}) AS cluster_seed_{s}' for s in (17, 42, 73))} FROM y",
    "manifest_checksums": "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents",
}
