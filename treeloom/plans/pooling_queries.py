"""Pooling of token vectors of legacy_records: weights, selections, modes, grids and the streaming form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.vectors import masked_mean, truncated_mean
from treeloom.operators.checks import unmatched
from treeloom.operators.experiments import sensitivity_grid
from treeloom.operators.pooling import Pooling, accumulation_summary, missing_documents, part_vectors, partial_sums, pool, pool_grid, record_depths, weight
from treeloom.session import fresh_path
from treeloom.streaming.accumulate import accumulate_stream, finalize, stream_windows

RAW = dict(unit_before=False, unit_after=False)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/token_entries.parquet")


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_depths(spark.read.parquet(f"{sf_dir}/legacy_records.parquet"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_vectors(_entries(spark, sf_dir)).join(_depths(spark, sf_dir), ["patent_id", "claim_id"])


def _long(df: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    out = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return out.select(*keys, F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + F.lit(0.0)).alias("value"))


def _pooled(p: Pooling):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(pool(_parts(spark, sf_dir), p), "patent_id")

    return query


def truncated_token_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mean vector per claim, over the first num_tokens stored token vectors."""
    return _long(part_vectors(_entries(spark, sf_dir)), "patent_id", "claim_id")


def masked_token_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of masked means with weights 1, 2, 3, 0 in turn along the tokens, per shard."""
    mask = F.transform("token_embeddings", lambda _, i: ((i + 1) % 4).cast("double"))
    mean = _entries(spark, sf_dir).select("shard", masked_mean(F.col("token_embeddings"), mask).alias("v"))
    clean = mean.filter(F.coalesce(F.forall("v", lambda x: ~F.isnan(x)), F.lit(False)))
    return clean.groupBy("shard").agg(F.count("*").alias("n"), (F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)), 4) + F.lit(0.0)).alias("total"))


def claim_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depths(spark, sf_dir).select("patent_id", "claim_id", "depth", (F.round(weight(F.col("depth"), Pooling()), 9) + F.lit(0.0)).alias("weight"))


def token_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule, the number of token rows that break it."""
    e = _entries(spark, sf_dir)
    depth = _depths(spark, sf_dir).select("patent_id", "claim_id", F.lit(True).alias("known"))
    bad = F.exists("token_embeddings", lambda t: F.exists(t, lambda x: x.isNull() | F.isnan(x)))
    rules = {
        "num_tokens_null": F.col("num_tokens").isNull(),
        "num_tokens_differs": F.col("num_tokens").isNotNull() & (F.col("num_tokens") != F.size("token_embeddings")),
        "not_finite": F.coalesce(bad, F.lit(False)),
        "no_depth": F.col("known").isNull(),
        "encoded_at_null": F.col("encoded_at").isNull(),
    }
    told = e.join(depth, ["patent_id", "claim_id"], "left").agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return told.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("e")).select("e.rule", "e.n")


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, claims and truncated entries of each shard."""
    return _entries(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_entries"), F.countDistinct("patent_id", "claim_id").alias("n_claims"), F.count_if("truncated").alias("n_truncated"))


def pooled_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy records without any usable claim vector."""
    docs = spark.read.parquet(f"{sf_dir}/legacy_records.parquet").filter("patent_id is not null")
    return missing_documents(docs, pool(_parts(spark, sf_dir), Pooling(**RAW)))


def pooled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, completed and missing ones, and pooled claims."""
    docs = spark.read.parquet(f"{sf_dir}/legacy_records.parquet").filter("patent_id is not null")
    return accumulation_summary(docs, pool(_parts(spark, sf_dir), Pooling(**RAW)))


def ablation_pooling_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of 24 weightings: documents, and the mean over them of the pooled vector's first number and of its length."""
    grid = pool_grid(_parts(spark, sf_dir), sensitivity_grid(**RAW))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return grid.groupBy("pool").agg(F.count("*").alias("n"), (F.round(F.avg(F.get("vector", F.lit(0))), 6) + F.lit(0.0)).alias("mean_first"), (F.round(F.avg(length), 6) + F.lit(0.0)).alias("mean_norm"))


def shard_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of each shard's own claims: what an interrupted run would resume from."""
    e = _entries(spark, sf_dir)
    mean = truncated_mean(F.col("token_embeddings"), F.col("num_tokens"))
    each = e.filter("patent_id is not null and claim_id is not null").select("shard", "patent_id", "claim_id", mean.alias("vector")).distinct()
    each = each.filter(F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    sums = partial_sums(each.join(_depths(spark, sf_dir), ["patent_id", "claim_id"]), Pooling(**RAW), ["shard", "patent_id"])
    return sums.groupBy("shard").agg(F.count("*").alias("n_patents"), F.sum("n").alias("n_parts"), (F.round(F.sum("w"), 4) + F.lit(0.0)).alias("weight"))


def _in_files(df: DataFrame, name: str, by: str, files: int) -> str:
    """A copy of a table in several files, for a stream to read a few at a time; rows of one ``by`` lie in one file."""
    path = fresh_path(df.sparkSession, name)
    df.repartition(files, by).write.parquet(path)
    return path


def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of 12 files, three a batch, merged after two; equals the batch pooling of the same rows."""
    entries = _entries(spark, sf_dir)
    source, state = _in_files(entries, "entries", "shard", 12), fresh_path(spark, "state")
    accumulate_stream(spark, source, entries.schema, state, fresh_path(spark, "stream"), files_per_trigger=3, merge_after=2)
    return _long(finalize(spark, state, _depths(spark, sf_dir), Pooling(**RAW)), "patent_id")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hourly windows over a stream of 6 files, two a batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, out = _in_files(events, "events", "user_id", 6), fresh_path(spark, "windows")
    stream_windows(spark, source, events.schema, out, fresh_path(spark, "stream"), files_per_trigger=2)
    told = spark.read.parquet(out)
    return told.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


def token_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with token vectors but without a depth: what the join of the pooling leaves out."""
    return unmatched(_entries(spark, sf_dir).filter("patent_id is not null and claim_id is not null"), _depths(spark, sf_dir), ["patent_id", "claim_id"])


def stray_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard that lie outside their patent's home, the shard with most of its rows (of equal ones the first by name)."""
    number = _entries(spark, sf_dir).filter("patent_id is not null and shard is not null").groupBy("patent_id", "shard").agg(F.count("*").alias("n"))
    home = number.groupBy("patent_id").agg(F.min_by("shard", F.struct((-F.col("n")).alias("n"), "shard")).alias("home"))
    return number.join(home, "patent_id").filter("shard <> home").groupBy("shard").agg(F.sum("n").alias("n_rows"))


_MODES = {
    "pooled_all": Pooling(**RAW),
    "pooled_root_only": Pooling(selection="root_only", **RAW),
    "pooled_first_only": Pooling(selection="first_only", **RAW),
    "pooled_uniform": Pooling(root_weight=1.0, depth_decay=0.0, **RAW),
    "pooled_consistent_mode": Pooling(),
}

_PARTS = """
d0 AS (SELECT patent_id, unnest(map_entries(depth)) AS e FROM legacy_records WHERE depth IS NOT NULL),
dep AS (SELECT patent_id, e.key AS claim_id, min(e.value) AS depth FROM d0 WHERE e.value >= 0 GROUP BY 1, 2),
dp AS (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY claim_id) - 1 AS claim_pos FROM dep),
t0 AS (SELECT row_number() OVER () AS rid, * FROM token_entries WHERE patent_id IS NOT NULL AND claim_id IS NOT NULL),
t1 AS (SELECT rid, patent_id, claim_id, encoded_at, shard, unnest(token_embeddings[1:greatest(0, least(coalesce(num_tokens, len(token_embeddings)), len(token_embeddings)))]) AS v FROM t0),
t2 AS (SELECT rid, patent_id, claim_id, encoded_at, shard, unnest(range(len(v))) AS d, unnest(v)::DOUBLE AS x FROM t1),
t3 AS (SELECT rid, patent_id, claim_id, encoded_at, shard, d, sum(x) / count(*) AS x FROM t2 GROUP BY ALL),
t4 AS (SELECT rid, patent_id, claim_id, encoded_at, shard, list(x ORDER BY d) AS v FROM t3 GROUP BY ALL HAVING NOT bool_or(isnan(x))),
t5 AS (SELECT *, row_number() OVER (PARTITION BY patent_id, claim_id ORDER BY encoded_at IS NULL, encoded_at, v) AS rn FROM t4),
vec AS (SELECT patent_id, claim_id, v FROM t5 WHERE rn = 1),
part AS (SELECT patent_id, claim_id, v, depth, claim_pos FROM vec JOIN dp USING (patent_id, claim_id))
"""


def _pool_sql(a: float, d: float, where: str = "true", unit: bool = False) -> str:
    norm = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
    v = f"CASE WHEN {norm.format('v')} > 1e-12 THEN list_transform(v, lambda x: x / {norm.format('v')}) END" if unit else "v"
    return f"""WITH {_PARTS},
q AS (SELECT patent_id, {v} AS v, (CASE WHEN depth = 0 THEN {a}::DOUBLE ELSE 1.0::DOUBLE END) * exp(-{d}::DOUBLE * depth) AS w FROM part WHERE {where}),
l AS (SELECT patent_id, unnest(range(len(v))) AS dim, unnest(v) AS x, w FROM q),
m AS (SELECT patent_id, dim, sum(w * x) / sum(w) AS x FROM l GROUP BY 1, 2),
n AS (SELECT patent_id, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT patent_id, dim, round({'x / n.n' if unit else 'x'}, 6) + 0.0 AS value FROM m JOIN n USING (patent_id)"""


def _grid_sql() -> str:
    names = {g.name: (g.root_weight, g.depth_decay) for g in sensitivity_grid(**RAW)}
    values = ", ".join(f"('{k}', {a}::DOUBLE, {d}::DOUBLE)" for k, (a, d) in names.items())
    return f"""WITH {_PARTS}, g(pool, a, dd) AS (VALUES {values}),
l AS (SELECT pool, patent_id, unnest(range(len(v))) AS dim, unnest(v) AS x, (CASE WHEN depth = 0 THEN a ELSE 1.0::DOUBLE END) * exp(-dd * depth) AS w FROM part, g),
m AS (SELECT pool, patent_id, dim, sum(w * x) / sum(w) AS x FROM l GROUP BY 1, 2, 3),
n AS (SELECT pool, patent_id, sqrt(sum(x * x)) AS n, max(CASE WHEN dim = 0 THEN x END) AS f FROM m GROUP BY 1, 2)
SELECT pool, count(*) AS n, round(avg(f), 6) + 0.0 AS mean_first, round(avg(n), 6) + 0.0 AS mean_norm FROM n GROUP BY 1"""


QUERIES = {k: _pooled(p) for k, p in _MODES.items()}
for _name, _query in QUERIES.items():
    _query.__name__, _query.__doc__ = _name, f"Pooled vectors with {json.dumps(_MODES[_name].__dict__)}."
QUERIES |= {f.__name__: f for f in (truncated_token_mean, masked_token_mean, claim_weights, token_violations, token_shards, pooled_missing, pooled_summary, ablation_pooling_grid, shard_partials, stream_accumulate, event_counts, token_misses, stray_shards)}
ORACLES = {
    "pooled_all": _pool_sql(12, 0.1),
    "pooled_root_only": _pool_sql(12, 0.1, "depth = 0"),
    "pooled_first_only": _pool_sql(12, 0.1, "claim_pos = 0"),
    "pooled_uniform": _pool_sql(1, 0),
    "pooled_consistent_mode": _pool_sql(12, 0.1, unit=True),
    "truncated_token_mean": f"WITH {_PARTS} SELECT patent_id, claim_id, unnest(range(len(v))) AS dim, round(unnest(v), 6) + 0.0 AS value FROM vec",
    "masked_token_mean": """WITH t0 AS (SELECT row_number() OVER () AS rid, shard, token_embeddings AS t FROM token_entries WHERE len(token_embeddings) > 0),
t1 AS (SELECT rid, shard, unnest(t) AS v, unnest(range(len(t))) AS i FROM t0), t2 AS (SELECT rid, shard, (i + 1) % 4 AS w, unnest(range(len(v))) AS d, unnest(v)::DOUBLE AS x FROM t1),
t3 AS (SELECT rid, shard, d, sum(CASE WHEN w > 0 THEN w * x ELSE 0 END) / sum(w) AS x FROM t2 GROUP BY ALL HAVING sum(w) > 0), t4 AS (SELECT rid, shard, sum(x) AS x FROM t3 GROUP BY ALL HAVING NOT bool_or(isnan(x)))
SELECT shard, count(*) AS n, round(sum(x), 4) + 0.0 AS total FROM t4 GROUP BY 1""",
    "claim_weights": f"WITH {_PARTS} SELECT patent_id, claim_id, depth, round((CASE WHEN depth = 0 THEN 12::DOUBLE ELSE 1 END) * exp(-0.1::DOUBLE * depth), 9) + 0.0 AS weight FROM dep",
    "token_violations": f"""WITH {_PARTS}, e AS (SELECT t.*, dep.depth AS known FROM token_entries t LEFT JOIN dep USING (patent_id, claim_id))
SELECT unnest(['num_tokens_null', 'num_tokens_differs', 'not_finite', 'no_depth', 'encoded_at_null']) AS rule, unnest([count(*) FILTER (WHERE num_tokens IS NULL), count(*) FILTER (WHERE num_tokens <> len(token_embeddings)),
count(*) FILTER (WHERE list_bool_or(list_transform(flatten(token_embeddings), lambda x: x IS NULL OR isnan(x)))), count(*) FILTER (WHERE known IS NULL), count(*) FILTER (WHERE encoded_at IS NULL)]) AS n FROM e""",
    "token_shards": "SELECT shard, count(*) AS n_entries, count(DISTINCT (patent_id, claim_id)) AS n_claims, count(*) FILTER (WHERE truncated) AS n_truncated FROM token_entries GROUP BY 1",
    "pooled_missing": f"WITH {_PARTS} SELECT DISTINCT patent_id FROM legacy_records WHERE patent_id IS NOT NULL AND patent_id NOT IN (SELECT patent_id FROM part)",
    "pooled_summary": f"WITH {_PARTS}, n AS (SELECT DISTINCT patent_id FROM legacy_records WHERE patent_id IS NOT NULL), c AS (SELECT patent_id, count(*) AS k FROM part GROUP BY 1) SELECT count(*) AS n_documents, count(k) AS n_completed, count(*) - count(k) AS n_missing, coalesce(sum(k), 0)::BIGINT AS n_parts FROM n LEFT JOIN c USING (patent_id)",
    "ablation_pooling_grid": _grid_sql(),
    "shard_partials": f"""WITH {_PARTS}, u AS (SELECT DISTINCT shard, patent_id, claim_id, v FROM t4), j AS (SELECT shard, patent_id, (CASE WHEN depth = 0 THEN 12::DOUBLE ELSE 1 END) * exp(-0.1::DOUBLE * depth) AS w FROM u JOIN dep USING (patent_id, claim_id))
SELECT shard, count(DISTINCT patent_id) AS n_patents, count(*) AS n_parts, round(sum(w), 4) + 0.0 AS weight FROM j GROUP BY 1""",
    "stream_accumulate": _pool_sql(12, 0.1),
    "token_misses": f"WITH {_PARTS} SELECT DISTINCT patent_id, claim_id FROM token_entries WHERE patent_id IS NOT NULL AND claim_id IS NOT NULL AND (patent_id, claim_id) NOT IN (SELECT (patent_id, claim_id) FROM dep)",
    "stray_shards": """WITH n AS (SELECT patent_id, shard, count(*) AS n FROM token_entries WHERE patent_id IS NOT NULL AND shard IS NOT NULL GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY n DESC, shard) AS rn FROM n)
SELECT shard, sum(n)::BIGINT AS n_rows FROM h WHERE rn > 1 GROUP BY 1""",
    "event_counts": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
