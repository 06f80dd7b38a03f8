"""Structure-weighted pooling of part vectors into document vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.vectors import is_finite, l2, truncated_mean

SELECTIONS = ("all", "root_only", "first_only")


@dataclass(frozen=True)
class Pooling:
    """root_weight > 0 for parts of depth 0, depth_decay >= 0; unit vectors before and after pooling, or neither."""

    root_weight: float = 12.0
    depth_decay: float = 0.1
    selection: str = "all"
    unit_before: bool = True
    unit_after: bool = True

    def __post_init__(self) -> None:
        if not (0 < self.root_weight < float("inf")):
            raise ValueError("root_weight must be positive and finite")
        if not (0 <= self.depth_decay < float("inf")):
            raise ValueError("depth_decay must be finite and not negative")
        if self.selection not in SELECTIONS:
            raise ValueError(f"selection must be one of {SELECTIONS}")

    @property
    def name(self) -> str:
        return f"root{self.root_weight:g}_d{round(self.depth_decay * 100):03d}"


def weight(depth: Column, p: Pooling) -> Column:
    """root_weight at depth 0, else 1, times exp(-depth_decay * depth)."""
    return F.when(depth == 0, F.lit(float(p.root_weight))).otherwise(F.lit(1.0)) * F.exp(-F.lit(float(p.depth_decay)) * depth)


def part_vectors(entries: DataFrame) -> DataFrame:
    """(patent_id, claim_id, vector): one mean token vector per claim.

    Of a claim encoded several times the earliest row counts (null times last, equal times by content); rows
    without a finite mean (no tokens, NaN, null) are left out; num_tokens null or above the stored number means all.
    A claim encoded very often is reduced map-side.
    """
    return first_parts(part_candidates(entries)).select("patent_id", "claim_id", F.col("best.v").alias("vector"))


def first_parts(candidates: DataFrame) -> DataFrame:
    """(patent_id, claim_id, best): the earliest of several candidates; any grouping of the rows gives the same in the end."""
    return candidates.groupBy("patent_id", "claim_id").agg(F.min("best").alias("best"))


def part_candidates(entries: DataFrame) -> DataFrame:
    """(patent_id, claim_id, best struct<late, at, v>): the mean token vector of each row and what orders rows of one claim."""
    mean = truncated_mean(F.col("token_embeddings"), F.col("num_tokens"))
    each = entries.filter("patent_id is not null and claim_id is not null").select("patent_id", "claim_id", "encoded_at", mean.alias("vector"))
    each = each.filter(F.coalesce(is_finite(F.col("vector")), F.lit(False)))
    return each.select("patent_id", "claim_id", F.struct(F.col("encoded_at").isNull().alias("late"), F.col("encoded_at").alias("at"), F.col("vector").alias("v")).alias("best"))


def record_depths(records: DataFrame) -> DataFrame:
    """(patent_id, claim_id, depth, claim_pos) of legacy records; repeated rows count once, negative and null depths are left out."""
    kept = records.filter("patent_id is not null and depth is not null").select("patent_id", F.explode("depth").alias("claim_id", "depth")).filter("depth >= 0").groupBy("patent_id", "claim_id").agg(F.min("depth").alias("depth"))
    from pyspark.sql import Window

    return kept.withColumn("claim_pos", F.row_number().over(Window.partitionBy("patent_id").orderBy("claim_id")) - 1)


def select_parts(parts: DataFrame, selection: str) -> DataFrame:
    if selection == "root_only":
        return parts.filter("depth = 0")
    if selection == "first_only":
        return parts.filter("claim_pos = 0")
    return parts


def pool(parts: DataFrame, p: Pooling, key: str = "patent_id") -> DataFrame:
    """(key, vector, weight_sum, n_parts): the weighted mean of each document's part vectors.

    ``parts``: key, depth, claim_pos, vector.  The mean is summed map-side by the ML summarizer; a document
    whose parts are all left out gives no row; near-zero vectors give null where unit vectors are asked for.
    """
    chosen = select_parts(parts, p.selection)
    vector = l2(F.col("vector")) if p.unit_before else F.col("vector").cast("array<double>")
    chosen = chosen.select(key, array_to_vector(vector).alias("v"), weight(F.col("depth"), p).alias("w")).filter("v is not null")
    told = chosen.groupBy(key).agg(Summarizer.mean(F.col("v"), F.col("w")).alias("mean"), F.sum("w").alias("weight_sum"), F.count("*").alias("n_parts"))
    mean = vector_to_array("mean")
    return told.select(key, (l2(mean) if p.unit_after else mean).alias("vector"), "weight_sum", "n_parts")


def pool_grid(parts: DataFrame, grid: list[Pooling], key: str = "patent_id") -> DataFrame:
    """(pool, key, vector) for many weightings of one selection, from one pass over the parts.

    Weights depend on depth alone, so vectors are first summed per document and depth; each weighting
    then combines a handful of sums.
    """
    first = grid[0]
    if any((g.selection, g.unit_before) != (first.selection, first.unit_before) for g in grid):
        raise ValueError("a grid needs one selection and one unit_before")
    vector = l2(F.col("vector")) if first.unit_before else F.col("vector").cast("array<double>")
    base = select_parts(parts, first.selection).select(key, "depth", array_to_vector(vector).alias("v")).filter("v is not null")
    sums = base.groupBy(key, "depth").agg(Summarizer.sum(F.col("v")).alias("s"), F.count("*").alias("n")).select(key, "depth", vector_to_array("s").alias("s"), "n")
    made = F.array(*[F.struct(F.lit(g.name).alias("pool"), weight(F.col("depth"), g).alias("w"), F.lit(g.unit_after).alias("unit")) for g in grid])
    each = sums.select(key, "s", "n", F.explode(made).alias("g")).select(key, "g.pool", "g.unit", array_to_vector(F.transform("s", lambda x: x * F.col("g.w"))).alias("v"), (F.col("n") * F.col("g.w")).alias("w"))
    total = each.groupBy("pool", "unit", key).agg(Summarizer.sum(F.col("v")).alias("v"), F.sum("w").alias("w"))
    mean = F.transform(vector_to_array("v"), lambda x: x / F.col("w"))
    return total.select("pool", key, F.when(F.col("unit"), l2(mean)).otherwise(mean).alias("vector"))


def missing_documents(documents: DataFrame, pooled: DataFrame, key: str = "patent_id") -> DataFrame:
    """Documents that got no vector."""
    return documents.select(key).distinct().join(pooled.filter("vector is not null").select(key), key, "left_anti")


def merge_partials(partials: DataFrame, key: str = "patent_id") -> DataFrame:
    """Merge the partial sums (key, s array<double>, w, n) of any number of shards into mean vectors; a document may lie in many shards."""
    merged = partials.groupBy(key).agg(Summarizer.sum(array_to_vector(F.col("s"))).alias("s"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    return merged.select(key, F.transform(vector_to_array("s"), lambda x: x / F.col("w")).alias("vector"), F.col("w").alias("weight_sum"), F.col("n").alias("n_parts"))


def partial_sums(parts: DataFrame, p: Pooling, by: list[str]) -> DataFrame:
    """The accumulator's state: weighted sum, weight and number of parts of each group."""
    vector = l2(F.col("vector")) if p.unit_before else F.col("vector").cast("array<double>")
    w = weight(F.col("depth"), p)
    base = select_parts(parts, p.selection).select(*by, vector.alias("v"), w.alias("w")).filter("v is not null")
    base = base.select(*by, array_to_vector(F.transform("v", lambda x: x * F.col("w"))).alias("v"), "w")
    return base.groupBy(*by).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))


def accumulation_summary(documents: DataFrame, pooled: DataFrame, key: str = "patent_id") -> DataFrame:
    """One row: documents, those with a vector, those without, and all pooled parts."""
    both = documents.select(key).distinct().join(pooled.select(key, "n_parts", F.col("vector").isNotNull().alias("done")), key, "left")
    return both.agg(F.count("*").alias("n_documents"), F.count_if("done").alias("n_completed"), F.count_if(~F.coalesce("done", F.lit(False))).alias("n_missing"), F.coalesce(F.sum("n_parts"), F.lit(0)).alias("n_parts"))
