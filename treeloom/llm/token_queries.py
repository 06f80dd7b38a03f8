"""Problem 6 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm.tokens import encode_corpus


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document under byte_bpe_50k."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
ORACLES: dict[str, str] = {}
