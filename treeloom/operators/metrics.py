"""Agreement of two labelings, from their contingency table in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import label

AVERAGES = ("arithmetic", "geometric", "min", "max")


def contingency(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, truth, predicted, n); rows with a null on either side are left out."""
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def scores(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: n, purity, inverse_purity, ari and nmi by all four averages.

    Two labelings that are both trivial agree fully (nmi 1, ari 1); no mutual information gives nmi 0.  One
    aggregate per margin over the contingency table, whose size is that of the label sets.
    """
    by = tuple(by)
    keys = [F.col(c) for c in by]
    pair = lambda c: F.sum(c * (c - 1) / 2)
    xlogx = lambda c: F.sum(c * F.ln(c))
    n = F.col("n").cast("double")
    rows = table.groupBy(*keys, "truth").agg(F.sum("n").alias("n"), F.max("n").alias("top")).groupBy(*keys).agg(pair(n).alias("pairs_t"), xlogx(n).alias("log_t"), F.sum("top").alias("top_t"), F.count("*").alias("k_t"))
    cols = table.groupBy(*keys, "predicted").agg(F.sum("n").alias("n"), F.max("n").alias("top")).groupBy(*keys).agg(pair(n).alias("pairs_p"), xlogx(n).alias("log_p"), F.sum("top").alias("top_p"), F.count("*").alias("k_p"))
    cells = table.groupBy(*keys).agg(pair(n).alias("pairs"), xlogx(n).alias("log_c"), F.sum("n").cast("double").alias("total"))
    one = cells.join(rows, list(by)).join(cols, list(by)) if by else cells.crossJoin(rows).crossJoin(cols)  # single rows
    total = F.col("total")
    h_t, h_p = F.ln(total) - F.col("log_t") / total, F.ln(total) - F.col("log_p") / total
    mi = F.ln(total) + (F.col("log_c") - F.col("log_t") - F.col("log_p")) / total
    trivial = (F.col("k_t") == 1) & (F.col("k_p") == 1)
    means = {"arithmetic": (h_t + h_p) / 2, "geometric": F.sqrt(F.abs(h_t * h_p)), "min": F.least(h_t, h_p), "max": F.greatest(h_t, h_p)}
    nmi = [F.when(trivial, 1.0).when((mi < 1e-14) | (m < 1e-14), 0.0).otherwise(mi / m).alias(f"nmi_{k}") for k, m in means.items()]
    every = total * (total - 1) / 2
    expected = F.when(every > 0, F.col("pairs_t") * F.col("pairs_p") / every).otherwise(0.0)
    spread = (F.col("pairs_t") + F.col("pairs_p")) / 2 - expected
    ari = F.when(F.abs(spread) < 1e-12, 1.0).otherwise((F.col("pairs") - expected) / spread).alias("ari")
    return one.filter("total > 0").select(*by, total.cast("bigint").alias("n"), (F.col("top_p") / total).alias("purity"), (F.col("top_t") / total).alias("inverse_purity"), ari, *nmi)


def label_match(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: compared rows, equal ones, their share, unequal ones, and ari and nmi, which don't ask for equal names; a null equals a null only."""
    same = F.col(a).eqNullSafe(F.col(b))
    one = df.agg(F.count("*").alias("n"), F.count_if(same).alias("n_equal"), F.count_if(~same).alias("n_unequal")).withColumn("match_rate", F.when(F.col("n") > 0, F.col("n_equal") / F.col("n")))
    agree = scores(contingency(df, a, b)).select("ari", F.col("nmi_arithmetic").alias("nmi"))
    return one.join(agree, F.lit(True), "left")  # two single rows


def require_labels(df: DataFrame, *columns: str, shown: int = 10) -> DataFrame:
    """``df`` with its labels as stripped text; null and blank ones raise a ``ValueError`` with the first rows."""
    told = df.withColumns({c: label(F.col(c).cast("string")) for c in columns})
    bad = told.filter(" or ".join(f"`{c}` is null" for c in columns)).limit(shown).collect()
    if bad:
        raise ValueError(f"null or blank labels: {'; '.join(str(tuple(r)) for r in bad)}")
    return told


def by_level(df: DataFrame, levels: tuple[str, ...], predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores for each label level (and group) in one pass: levels are unpivoted before the contingency table."""
    long = df.select(*by, predicted, F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("truth_label")) for c in levels])).alias("l")).select(*by, predicted, "l.level", "l.truth_label")
    return scores(contingency(long, "truth_label", predicted, (*by, "level")), (*by, "level"))


def seed_summary(scored: DataFrame, metrics: tuple[str, ...] = ("nmi_arithmetic", "purity", "inverse_purity")) -> DataFrame:
    """(level, metric, mean, std): over seeds, with the population's deviation; level 'mean' is the unweighted mean over levels."""
    long = scored.select("seed", "level", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("seed", "level", "m.metric", "m.value")
    whole = long.groupBy("seed", "metric").agg(F.avg("value").alias("value")).select("seed", F.lit("mean").alias("level"), "metric", "value")
    return long.unionByName(whole).groupBy("level", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def run_summary(df: DataFrame, cluster: str, similarity: str, by: str = "seed") -> DataFrame:
    """(metric, mean, std) over runs of their objective (mean of 1 - similarity), number of active clusters and greatest share.  Nulls are left out."""
    each = cluster_balance(df, cluster, 0, (by,)).join(df.groupBy(by).agg(F.avg(1 - F.col(similarity).cast("double")).alias("objective")), by)
    long = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("objective", "active_clusters", "max_share")])).alias("m")).select("m.metric", "m.value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def cluster_balance(df: DataFrame, cluster: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, active_clusters, max_share, n): over k possible clusters."""
    sizes = df.filter(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("active_clusters"), (F.max("n") / F.sum("n")).alias("max_share"), F.sum("n").alias("n"), F.lit(k).cast("bigint").alias("k"))
