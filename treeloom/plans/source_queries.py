"""Readers and sinks: what a query writes to the shared folder and reads back, against the table it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.vectors import norm
from treeloom.operators import kmeans
from treeloom.session import fresh_path
from treeloom.sources import arrays, readers, sinks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """demo_records as JSON with an object in each line, other field names, and read with the explicit schema: rows, claims, texts and parents by section."""
    path = fresh_path(spark, "records")
    claims = F.transform("claims", lambda c: F.struct(c.claim_id.alias("number"), c.text.alias("text"), c.parent_ids.alias("depends_on")))
    _table(spark, sf_dir, "demo_records").select(F.col("patent_id").alias("patent"), claims.alias("claims"), "cpc").write.json(path)
    df = readers.read_records(spark, path, names={"patent_id": "patent", "claim_id": "number", "parent_ids": "depends_on"})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return df.groupBy(F.col("cpc.section").alias("section")).agg(
        F.count("*").alias("n_records"), F.count("patent_id").alias("n_named"), total(F.size("claims")).alias("n_claims"), total(F.aggregate("claims", F.lit(0), lambda s, c: s + F.coalesce(F.length(c.text), F.lit(0)))).alias("n_characters"), total(F.aggregate("claims", F.lit(0), lambda s, c: s + F.coalesce(F.size(c.parent_ids), F.lit(0)))).alias("n_parents")
    )


def _archives(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "archives")
    units = kmeans.unit_rows(_table(spark, sf_dir, "patent_features"), "row_idx", "features")
    arrays.save_archives(units.repartition(3, "row"), path, "row", "v").collect()  # a row per file
    return path


def features_from_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors written as NumPy archives and read back: first number and length of each."""
    df = arrays.read_features(spark, _archives(spark, sf_dir))
    return df.select(F.col("patent_id").cast("bigint").alias("row_idx"), (F.round(F.col("features")[0].cast("double"), 5) + F.lit(0.0)).alias("first"), (F.round(norm(F.col("features")), 4) + F.lit(0.0)).alias("norm"))


def archive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of those archives: their rows in all, and columns."""
    return arrays.npz_keys(spark, _archives(spark, sf_dir)).groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


def assignments_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patent_labels as CSV and read with the explicit schema; blank labels read as nulls."""
    path = fresh_path(spark, "assignments")
    _table(spark, sf_dir, "patent_labels").repartition(3).write.option("header", True).csv(path)
    df = readers.read_assignments(spark, path)
    return df.groupBy(F.upper(F.trim("section")).alias("section")).agg(F.count("*").alias("n_rows"), F.sum("global_index").alias("sum_index"), F.count("patent_id").alias("n_named"))


def clustering_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three seeds with K = 5, saved and read back: rows, sum of counts and seeds by table."""
    path = fresh_path(spark, "clusterings")
    sinks.save_clusterings(kmeans.run_seeds(_table(spark, sf_dir, "patent_features"), "row_idx", "features", 5, [17, 42, 73], max_iter=20), path)
    labels, centres, summary = (spark.read.parquet(f"{path}/{t}") for t in ("labels", "centroids", "summary"))
    both = labels.groupBy("seed").agg(F.count("*").alias("n_labels")).join(centres.groupBy("seed").agg(F.count("*").alias("n_centroids"), F.sum("count").alias("n_counted")), "seed")
    return both.join(summary.select("seed", F.col("active_clusters").cast("bigint").alias("n_active")), "seed").select(F.col("seed").cast("int").alias("seed"), "n_labels", "n_centroids", "n_counted", "n_active")


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """common_words as a text file for each language, and the length and SHA-256 of every file."""
    path = fresh_path(spark, "words")
    _table(spark, sf_dir, "common_words").select("lang", "word", "word_rank").repartition(1).sortWithinPartitions("lang", "word_rank", "word").select("lang", "word").write.partitionBy("lang").text(path)  # a fixed table
    found = sinks.checksums(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), F.col("length").alias("n_bytes"), "sha256")


def shards_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that a resumed run has to do where the partials of all but shards of even length were saved, and one shard's source has grown since."""
    e = _table(spark, sf_dir, "token_entries").filter("shard is not null")
    sizes = e.groupBy("shard").agg(F.count("*").alias("source_size"))
    done = e.select("shard", "patent_id").distinct().join(sizes.filter("source_size % 2 = 1"), "shard").drop("source_size")
    path = fresh_path(spark, "partials")
    sinks.save_partials(done, path, sinks.config_signature({"root_weight": 12, "depth_decay": 0.1}), sizes)
    first = sizes.agg(F.min("shard").alias("first"))
    now = sizes.crossJoin(first).select("shard", F.when(F.col("shard") == F.col("first"), F.col("source_size") + 1).otherwise(F.col("source_size")).alias("source_size"))  # one row
    return sinks.shards_to_do(now, spark.read.parquet(path), sinks.config_signature({"depth_decay": 0.1, "root_weight": 12})).select("shard")


QUERIES = {f.__name__: f for f in (records_from_lines, features_from_archives, archive_keys, assignments_from_csv, clustering_archives, file_checksums, shards_resumed)}

_VALID = """f AS (SELECT row_idx, min(features) AS v FROM patent_features WHERE row_idx IS NOT NULL AND features IS NOT NULL AND len(features) > 0 AND NOT list_bool_or(list_transform(features, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
      AND sqrt(list_sum(list_transform(features, lambda x: x::DOUBLE * x::DOUBLE))) > 1e-12 GROUP BY row_idx)"""
ORACLES = {
    "records_from_lines": """SELECT cpc.section AS section, count(*) AS n_records, count(patent_id) AS n_named, coalesce(sum(len(claims)), 0)::BIGINT AS n_claims, coalesce(sum(list_sum(list_transform(claims, lambda c: coalesce(length(c.text), 0)))), 0)::BIGINT AS n_characters,
 coalesce(sum(list_sum(list_transform(claims, lambda c: coalesce(len(c.parent_ids), 0)))), 0)::BIGINT AS n_parents FROM demo_records GROUP BY 1""",
    "features_from_archives": f"WITH {_VALID}, u AS (SELECT row_idx, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM f) SELECT row_idx, round((v[1]::DOUBLE / n)::FLOAT::DOUBLE, 5) + 0.0 AS first, 1.0::DOUBLE AS norm FROM u",
    "archive_keys": f"WITH {_VALID} SELECT unnest(['features', 'patent_ids']) AS key, unnest([count(*), count(*)]) AS n_rows, unnest([64, 1]::BIGINT[]) AS n_columns FROM f",
    "assignments_from_csv": "SELECT upper(nullif(trim(section), '')) AS section, count(*) AS n_rows, sum(global_index)::BIGINT AS sum_index, count(patent_id) AS n_named FROM patent_labels GROUP BY 1",
    "clustering_archives": f"WITH {_VALID} SELECT unnest([17, 42, 73]::INT[]) AS seed, count(*) AS n_labels, 5::BIGINT AS n_centroids, count(*) AS n_counted, 5::BIGINT AS n_active FROM f",
    "file_checksums": "SELECT lang, strlen(string_agg(word || chr(10), '' ORDER BY word_rank, word)) AS n_bytes, sha256(string_agg(word || chr(10), '' ORDER BY word_rank, word)) AS sha256 FROM common_words GROUP BY lang",
    "shards_resumed": "WITH s AS (SELECT shard, count(*) AS n FROM token_entries WHERE shard IS NOT NULL GROUP BY 1) SELECT shard FROM s WHERE n % 2 = 0 OR shard = (SELECT min(shard) FROM s)",
}
