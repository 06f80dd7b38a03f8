"""Problem 3 over demo_records and cut_limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.text import strip
from treeloom.llm.splitting import split_oversized
from treeloom.operators.delivery import first_delivery
from treeloom.session import small_side


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with the claims above the limit of its source; everything else is dropped in the scan's stage."""
    limits = spark.read.parquet(f"{sf_dir}/cut_limits.parquet").filter("source is not null").dropDuplicates(["source"])
    df = spark.read.parquet(f"{sf_dir}/demo_records.parquet").select("record_id", "received_at", "source", "claims").join(small_side(limits), "source")
    large = F.filter(
        F.transform("claims", lambda c, i: F.struct(i.alias("claim_pos"), c.claim_id.alias("claim_id"), c.text.alias("text"))),
        lambda c: F.char_length(c.text) > F.col("max_chars"),
    )
    return df.select("record_id", "received_at", "source", "max_chars", "overlap_chars", large.alias("large")).filter(F.size("large") > 0)


def _exploded(df: DataFrame, *more: str) -> DataFrame:
    flat = df.select("record_id", "source", "max_chars", "overlap_chars", F.inline("large")).withColumn("claim_id", strip("claim_id"))
    return flat.withColumn("size", F.char_length("text")) if "size" in more else flat


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that the splitter cuts."""
    pieces = split_oversized(_exploded(_oversized(spark, sf_dir)), "text", "max_chars", "overlap_chars", ["record_id", "claim_id"], with_text=False)
    return pieces.filter("piece_no = 1 and n_pieces > 1").select("record_id", "claim_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized claims; a record delivered twice counts once."""
    once = first_delivery(_oversized(spark, sf_dir))
    return split_oversized(_exploded(once), "text", "max_chars", "overlap_chars", ["record_id", "claim_pos", "claim_id", "max_chars", "overlap_chars"])


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: oversized claims, and what must not be: pieces above the limit, wrong overlaps, claims whose pieces don't reach from end to end."""
    pieces = split_oversized(_exploded(first_delivery(_oversized(spark, sf_dir)), "size"), "text", "max_chars", "overlap_chars", ["record_id", "claim_pos", "source", "size", "max_chars", "overlap_chars"], with_text=False)
    kept = F.greatest(F.lit(0), F.least("overlap_chars", F.col("max_chars") - 1))
    before = F.lag("piece_end").over(Window.partitionBy("record_id", "claim_pos").orderBy("piece_no"))
    each = pieces.withColumn("before", before)
    claim = each.groupBy("source", "record_id", "claim_pos", "size").agg(F.min("piece_begin").alias("begin"), F.max("piece_end").alias("end"), F.count_if(F.col("piece_end") - F.col("piece_begin") > F.col("max_chars")).alias("long"), F.count_if(F.col("before").isNotNull() & (F.col("piece_begin") != F.col("before") - kept)).alias("apart"))
    return claim.groupBy("source").agg(F.count("*").alias("n_claims"), F.sum("long").alias("n_too_long"), F.sum("apart").alias("n_wrong_overlap"), F.count_if((F.col("begin") != 0) | (F.col("end") != F.col("size"))).alias("n_not_whole"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checks": p3_checks}
ORACLES = {
    "p3_checks": "WITH r AS (SELECT record_id, any_value(source) AS source, any_value(claims) AS claims FROM demo_records GROUP BY record_id), x AS (SELECT source, unnest(claims) AS c FROM r) SELECT x.source AS source, count(*) AS n_claims, 0::BIGINT AS n_too_long, 0::BIGINT AS n_wrong_overlap, 0::BIGINT AS n_not_whole FROM x JOIN cut_limits l ON l.source = x.source WHERE length(x.c.text) > l.max_chars GROUP BY x.source",
    "p3_found": r"""SELECT DISTINCT x.record_id, trim(x.c.claim_id, e' \t\n\r') AS claim_id FROM (SELECT record_id, source, unnest(claims) AS c FROM demo_records) x JOIN cut_limits l ON l.source = x.source WHERE length(x.c.text) > l.max_chars""",
}
