"""Problem 7 over documents and pack_capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.packing import containers, faults, mixture, pack, target_shares
from treeloom.llm.tokens import encode_corpus
from treeloom.session import write_table


def _capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pack_capacity.parquet").select("name", F.col("max_tokens").alias("capacity"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sizes in tokens of byte_bpe_50k."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", only_counts=True, keep=("source",))


def _pack(spark: SparkSession, sf_dir: str, sized: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    return pack(sized, "doc_id", "source", "n_tokens", _capacities(spark, sf_dir), shares)


def p7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each document, or piece of one, for each capacity."""
    return _pack(spark, sf_dir, _sized(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of containers and unused space per capacity."""
    return containers(p7_assignments(spark, sf_dir), _capacities(spark, sf_dir))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural proportion of each source, and the range of its share over the windows."""
    sized, _ = write_table(_sized(spark, sf_dir), "sized")
    return mixture(_pack(spark, sf_dir, sized), target_shares(sized, "source", "n_tokens"))


def p7_mixture_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every named source is asked for in equal proportion, whatever it holds: queues that hold less end early."""
    sized, _ = write_table(_sized(spark, sf_dir), "sized")
    names = [r["source"] for r in sized.select("source").filter("source is not null").distinct().orderBy("source").limit(MOST_NAMED + 1).collect()]
    if len(names) > MOST_NAMED:
        raise ValueError("too many sources to name each one's share")
    shares = {name: 1.0 for name in names}
    return mixture(_pack(spark, sf_dir, sized, shares), target_shares(sized, "source", "n_tokens", shares))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed once and whole, no container above its capacity, nothing split that fits."""
    sized, _ = write_table(_sized(spark, sf_dir), "sized")
    return faults(_pack(spark, sf_dir, sized), sized, "doc_id", "n_tokens", _capacities(spark, sf_dir)).drop("n_tokens")


#: Sources whose shares a query names: a setting, not data.
MOST_NAMED = 1000
QUERIES = {f.__name__: f for f in (p7_assignments, p7_containers, p7_mixture, p7_mixture_asked, p7_checks)}
ORACLES = {"p7_checks": "SELECT name, (SELECT count(*) FROM documents) AS n_items, 0::BIGINT AS n_overfull, 0::BIGINT AS n_not_whole, 0::BIGINT AS n_needless, 0::BIGINT AS n_lost FROM pack_capacity WHERE max_tokens > 0"}
