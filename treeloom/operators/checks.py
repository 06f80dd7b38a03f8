"""Alignment of tables and comparison of matrices, as one-row reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.vectors import dot, is_finite, norm
from treeloom.session import write_table


def norm_summary(df: DataFrame, vector: str) -> DataFrame:
    """One row: n, n_invalid (null or not finite), and over the rest least, mean and greatest norm and greatest distance from 1."""
    ok = F.coalesce(is_finite(F.col(vector)), F.lit(False))
    n = F.when(ok, norm(F.col(vector)))
    return df.select(n.alias("n")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("n").isNull()).alias("n_invalid"), F.min("n").alias("min_norm"), F.avg("n").alias("mean_norm"), F.max("n").alias("max_norm"), F.max(F.abs(F.col("n") - 1)).alias("max_unit_error"))


def compare_matrices(left: DataFrame, right: DataFrame, key: str, vector: str, atol: float = 1e-6, rtol: float = 1e-5, least_cosine: float = 0.99999, most: float | None = None) -> DataFrame:
    """One row on the rows that both have: differences by number, cosines by row, and whether all are close.

    n_left_only, n_right_only count rows without a partner; pairs of different lengths count as misfits.  ``most`` is a limit for
    the greatest difference; ``all_equal`` tells whether all numbers are the same.  Null numbers make a row neither close nor equal.
    """
    both = left.select(key, F.col(vector).cast("array<double>").alias("a")).join(right.select(key, F.col(vector).cast("array<double>").alias("b")), key, "full_outer")
    pairs = both.select(
        key, "a", "b",
        (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.size("a") == F.size("b"))).alias("fits"),
    )
    told, _ = write_table(
        pairs.select(
            F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b"), "fits",
            F.when(F.col("fits"), dot(F.col("a"), F.col("b")) / F.greatest(norm(F.col("a")) * norm(F.col("b")), F.lit(1e-12))).alias("cosine"),
            F.when(F.col("fits"), F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("d"),
            F.when(F.col("fits"), F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda z: z)).alias("close"),
            (F.col("fits") & F.forall(F.zip_with("a", "b", lambda x, y: x == y), lambda z: z)).alias("same"),
        ),
        "differences",
    )
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    one = told.agg(
        F.count_if("fits").alias("n_rows"), F.count_if("no_b").alias("n_left_only"), F.count_if("no_a").alias("n_right_only"), F.count_if(~F.col("fits") & ~F.col("no_a") & ~F.col("no_b")).alias("n_misfits"),
        F.min("cosine").alias("min_cosine"), F.avg("cosine").alias("mean_cosine"), F.max(F.array_max("d")).alias("max_difference"), (F.sum(total) / F.sum(F.size("d"))).alias("mean_difference"),
        F.coalesce(F.bool_and("close"), F.lit(False)).alias("all_close"), F.coalesce(F.bool_and("same"), F.lit(False)).alias("all_equal"),
    )
    p99 = quantile(told.filter("fits"), "d", 0.99)
    fine = F.col("all_close") & (F.col("min_cosine") >= least_cosine) & (F.col("n_left_only") + F.col("n_right_only") + F.col("n_misfits") == 0)
    if most is not None:
        fine = fine & (F.col("max_difference") <= most)
    return one.withColumn("p99_difference", F.lit(p99).cast("double")).withColumn("passed", fine)


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """Exact quantile, linear between neighbours, of all the numbers in a column of arrays of numbers that are not negative; None without any.

    Such numbers sort like their bits.  Four passes each count one more group of 16 bits among the numbers that agree with the
    sought ones in the bits before: tasks send at most 65,536 counts for each of two ranks, whatever the table's size.
    """
    n = df.agg(F.sum(F.size(column))).first()[0] or 0
    if not n:
        return None
    low = int(share * (n - 1))
    ranks, prefixes = [low, min(low + 1, n - 1)], [0, 0]

    for turn in range(4):
        shift = 48 - 16 * turn
        wanted = sorted(set(prefixes))

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, wanted: list[int] = wanted) -> Iterator[pa.RecordBatch]:
            held = {p: np.zeros(1 << 16, np.int64) for p in wanted}
            for batch in batches:
                bits = (batch.column(0).flatten().to_numpy(zero_copy_only=False) + 0.0).view(np.uint64)
                above = bits >> np.uint64(shift) >> np.uint64(16)
                for p in wanted:
                    held[p] += np.bincount(((bits[above == np.uint64(p)] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            for p, cells in held.items():
                at = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int64)), pa.array(at), pa.array(cells[at])], ["prefix", "cell", "n"])

        counted = df.select(F.col(column).cast("array<double>")).mapInArrow(count, "prefix bigint, cell bigint, n bigint").groupBy("prefix", "cell").agg(F.sum("n").alias("n")).toPandas()
        for k, (rank, prefix) in enumerate(zip(ranks, prefixes)):
            mine = counted[counted["prefix"] == prefix].sort_values("cell")
            upto = mine["n"].cumsum().to_numpy()
            i = int(np.searchsorted(upto, rank, "right"))
            ranks[k] = rank - (int(upto[i - 1]) if i else 0)
            prefixes[k] = (prefix << 16) | int(mine["cell"].iloc[i])
    a, b = (float(np.uint64(p).view(np.float64)) for p in prefixes)
    return a + (share * (n - 1) - low) * (b - a)


def alignment(left: DataFrame, right: DataFrame, left_key: str, right_key: str, columns: list[str]) -> DataFrame:
    """(column, n_both, n_unequal, n_left_only, n_right_only): null-safe comparison of columns of two tables on a key."""
    a = left.select(F.col(left_key).alias("_k"), F.struct(*columns).alias("_a"))
    b = right.select(F.col(right_key).alias("_k"), F.struct(*columns).alias("_b"))
    both = a.join(b, "_k", "full_outer")
    counts = [F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).cast("bigint")).alias(f"x{k}") for k, c in enumerate(columns)]
    one = both.agg(F.count_if(F.expr("_a is not null and _b is not null")).alias("n_both"), F.count_if(F.expr("_b is null")).alias("n_left_only"), F.count_if(F.expr("_a is null")).alias("n_right_only"), *counts)
    return one.select("n_both", "n_left_only", "n_right_only", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"x{k}").alias("n_unequal")) for k, c in enumerate(columns)])).alias("e")).select("e.column", "n_both", "e.n_unequal", "n_left_only", "n_right_only")


def index_is_complete(df: DataFrame, key: str) -> DataFrame:
    """One row: whether the key is exactly 0, 1, ... n - 1."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_distinct"), F.min(key).alias("least"), F.max(key).alias("most")).withColumn("complete", (F.col("n") == F.col("n_distinct")) & (F.col("least") == 0) & (F.col("most") == F.col("n") - 1))


def missing_labels(df: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(level, n_missing): null or blank labels."""
    return df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(c) for c in levels]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("n_missing")) for c in levels])).alias("e")).select("e.level", "e.n_missing")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks: what an inner join would drop without a word.  Null keys match nothing."""
    return left.select(*keys).join(right.select(*keys), keys, "left_anti").distinct()


def join_strict(left: DataFrame, right: DataFrame, keys: list[str], what: str, shown: int = 10) -> DataFrame:
    """Inner join that raises a ``ValueError`` with the first misses instead of dropping them."""
    missing = unmatched(left, right, keys).limit(shown).collect()
    if missing:
        raise ValueError(f"{what}: {'; '.join(str(tuple(r)) for r in missing)}")
    return left.join(right, keys)


def align_positions(left: DataFrame, right: DataFrame, key: str, what: str = "rows") -> DataFrame:
    """Both tables side by side by position; positions that only one of them has, and null or repeated ones, raise a ``ValueError``."""
    for name, df in (("left", left), ("right", right)):
        told = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).first()
        if told["n"] != told["d"]:
            raise ValueError(f"{what}: null or repeated positions on the {name}")
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    alone = both.agg(F.count_if(F.col("_r").isNull()).alias("l"), F.count_if(F.col("_l").isNull()).alias("r")).first()
    if alone["l"] or alone["r"]:
        raise ValueError(f"{what}: {alone['l']} positions only on the left, {alone['r']} only on the right")
    return both.drop("_l", "_r")


def positions(df: DataFrame, key: str) -> DataFrame:
    """(key, row_idx): distinct keys that are not null, numbered from 0 in their order, without a sort in one task.

    Ranges are sorted by themselves; only their counts, a row each, reach the driver.
    """
    ranges = df.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    ranges, _ = write_table(ranges, "ranges")
    counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    offsets = dict(zip([k for k, _ in counts], np.cumsum([0] + [n for _, n in counts]).tolist()))
    before = F.broadcast(df.sparkSession.createDataFrame(list(offsets.items()), "_range int, _before bigint"))  # one row per range
    number = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranges.withColumn("_n", number).join(before, "_range").select(key, (F.col("_before") + F.col("_n") - 1).cast("bigint").alias("row_idx"))
