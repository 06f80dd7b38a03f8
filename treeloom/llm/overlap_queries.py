"""Problems 2 and 5 over demo_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.text import alnum_key, split_name
from treeloom.llm.overlap import cross_split, near_groups, near_pairs


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/demo_records.parquet")


def _texts():  # noqa: ANN202
    return F.transform("claims", lambda c: c.text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps between train and dev or test records."""
    return cross_split(_records(spark, sf_dir), "record_id", _texts(), split_name("split"), alnum_key("patent_id"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of overlaps per evaluation split and sources of both records."""
    facts = _records(spark, sf_dir).select("record_id", split_name("split").alias("split"), "source").filter("split in ('train', 'dev', 'test')").distinct()
    a = facts.select(F.col("record_id").alias("record_id_a"), F.col("split").alias("split_a"), F.col("source").alias("source_a"))
    b = facts.select(F.col("record_id").alias("record_id_b"), F.col("split").alias("split_b"), F.col("source").alias("source_b"))
    pairs = p2_found(spark, sf_dir).join(a, "record_id_a").join(b, "record_id_b").filter("(split_a = 'train') <> (split_b = 'train')")
    first = F.col("split_a") == "train"
    return pairs.groupBy(F.when(first, F.col("split_b")).otherwise(F.col("split_a")).alias("split"), F.when(first, F.col("source_b")).otherwise(F.col("source_a")).alias("source"), F.when(first, F.col("source_a")).otherwise(F.col("source_b")).alias("train_source")).agg(F.count("*").alias("n_pairs"), F.countDistinct(F.when(first, F.col("record_id_b")).otherwise(F.col("record_id_a"))).alias("n_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share at least 0.6 of their triples."""
    return near_pairs(_records(spark, sf_dir), "record_id", _texts())


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its group of near duplicates, its class of copies and its number of links."""
    return near_groups(_records(spark, sf_dir), "record_id", _texts())


_TRIPLES = r"""
r AS (SELECT record_id, any_value(split) AS split, any_value(patent_id) AS patent_id, any_value(source) AS source, any_value(claims) AS claims FROM demo_records GROUP BY record_id),
w AS (SELECT record_id, list_filter(regexp_split_to_array(lower(c.text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT record_id, unnest(claims) AS c FROM r) WHERE c.text IS NOT NULL),
t AS (SELECT DISTINCT record_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT record_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT record_id, count(*) AS n FROM t GROUP BY record_id)
"""
_SPLIT = r"lower(trim(split, e' \t\n\r'))"
_P2 = rf"""WITH {_TRIPLES},
s AS (SELECT record_id, {_SPLIT} AS split, nullif(regexp_replace(upper(patent_id), '[^A-Z0-9]', '', 'g'), '') AS pid, source FROM r),
ev AS (SELECT * FROM s WHERE split IN ('dev', 'test')), tr AS (SELECT * FROM s WHERE split = 'train'),
m AS (SELECT a.record_id AS e, b.record_id AS t, count(*) AS k FROM t a JOIN ev ON ev.record_id = a.record_id JOIN t b ON a.g = b.g JOIN tr ON tr.record_id = b.record_id GROUP BY a.record_id, b.record_id),
f AS (SELECT e, t FROM m JOIN n ON n.record_id = m.e WHERE k * 5 >= n * 4 UNION SELECT ev.record_id, tr.record_id FROM ev JOIN tr ON ev.pid = tr.pid)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_groups": p5_groups}
ORACLES = {
    "p2_found": _P2 + "SELECT least(e, t) AS record_id_a, greatest(e, t) AS record_id_b FROM f WHERE e <> t",
    "p2_report": _P2 + "SELECT ev.split AS split, ev.source AS source, tr.source AS train_source, count(*) AS n_pairs, count(DISTINCT f.e) AS n_records FROM f JOIN ev ON ev.record_id = f.e JOIN tr ON tr.record_id = f.t GROUP BY 1, 2, 3",
    "p5_found": f"""WITH {_TRIPLES},
m AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.record_id < b.record_id GROUP BY a.record_id, b.record_id)
SELECT m.a AS record_id_a, m.b AS record_id_b FROM m JOIN n x ON x.record_id = m.a JOIN n y ON y.record_id = m.b WHERE 8 * k >= 3 * (x.n + y.n)""",
    "p5_groups": f"""WITH RECURSIVE {_TRIPLES},
k AS (SELECT record_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM t GROUP BY record_id),
c AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_copies FROM k),
m AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS s FROM t a JOIN t b ON a.g = b.g AND a.record_id <> b.record_id GROUP BY a.record_id, b.record_id),
f AS (SELECT DISTINCT p.class_id AS a, q.class_id AS b FROM m JOIN n x ON x.record_id = m.a JOIN n y ON y.record_id = m.b JOIN c p ON p.record_id = m.a JOIN c q ON q.record_id = m.b WHERE 8 * s >= 3 * (x.n + y.n) AND p.class_id <> q.class_id),
l AS (SELECT a, count(*) AS n_links FROM f GROUP BY a),
u AS (SELECT class_id AS r, class_id AS v FROM c UNION SELECT u.r, f.b FROM u JOIN f ON f.a = u.v),
z AS (SELECT r, min(v) AS group_id FROM u GROUP BY r)
SELECT c.record_id, z.group_id, c.class_id, c.n_copies, coalesce(l.n_links, 0)::BIGINT AS n_links FROM c JOIN z ON z.r = c.class_id LEFT JOIN l ON l.a = c.class_id""",
}
