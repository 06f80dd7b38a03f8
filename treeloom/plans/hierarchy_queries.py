"""Problem 1 over demo_records: hierarchies of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.text import strip
from treeloom.operators.delivery import first_delivery
from treeloom.operators.hierarchy import ancestor_links, cyclic_nodes, peel_edges, peel_nested, peeled_descendants


def _links_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/demo_records.parquet").select("record_id", "received_at", F.col("claims.claim_id").alias("claim_id"), F.col("claims.parent_ids").alias("parent_ids"))
    return df.select("record_id", "received_at", F.arrays_zip("claim_id", "parent_ids").alias("claims"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that reach themselves.  Repeated deliveries give the same rows, which are distinct."""
    df = spark.read.parquet(f"{sf_dir}/demo_records.parquet")
    return cyclic_nodes(df, "record_id", "claims", "claim_id", "parent_ids").withColumnRenamed("node", "claim_id")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record delivered twice counts once."""
    return peel_nested(first_delivery(_links_only(spark, sf_dir)), "record_id", "claims", "claim_id", "parent_ids").withColumnRenamed("node", "claim_id")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with its status, depth, roots, paths and descendants; lists as text, their items sorted and joined by " | ", the nodes of a path by " > "."""
    paths = F.array_sort(F.transform("paths", lambda p: F.array_join(p, " > ")))
    joined = lambda c: F.array_join(c, " | ")
    return _described(spark, sf_dir).select("record_id", "claim_id", "status", "depth", joined(F.col("roots")).alias("roots"), joined(paths).alias("paths"), joined(F.col("descendants")).alias("descendants"))


def p1_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that spell out every path of every claim, however many there are."""
    return ancestor_links(_described(spark, sf_dir).withColumnRenamed("claim_id", "node"), "record_id").withColumnRenamed("node", "claim_id")


def _edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of all records as one table of links, named by record and claim; a claim without a known parent has a null one."""
    claim = spark.read.parquet(f"{sf_dir}/demo_records.parquet").select("record_id", F.inline(F.arrays_zip(F.col("claims.claim_id").alias("id"), F.col("claims.parent_ids").alias("up")))).select("record_id", strip("id").alias("id"), "up").filter("id is not null")
    named = claim.select("record_id", "id", F.explode("up").alias("parent")).select("record_id", "id", strip("parent").alias("parent"))
    known = named.join(claim.select("record_id", F.col("id").alias("parent")).distinct(), ["record_id", "parent"], "left_semi")
    every = claim.select("record_id", "id").distinct().join(known, ["record_id", "id"], "left")
    name = lambda c: F.concat_ws(":", "record_id", c)
    return every.select(name("id").alias("child"), F.when(F.col("parent").isNotNull(), name("parent")).alias("parent"))


def p1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed form over one table of links: height, depth, root, length of the path and number of descendants of every claim."""
    return peel_edges(_edge_table(spark, sf_dir)).select("node", "height", "depth", F.when(F.col("path").isNotNull(), F.size("path")).alias("path_length"), "n_descendants", "in_cycle_part")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, descendant) of every claim that leaf peeling takes."""
    return peeled_descendants(_edge_table(spark, sf_dir))


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of each claim's place, for comparison with SQL: depth, number of roots, paths and descendants."""
    return _described(spark, sf_dir).select("record_id", "claim_id", "depth", F.size("descendants").cast("bigint").alias("n_descendants"), F.coalesce(F.size("roots"), F.lit(-1)).cast("bigint").alias("n_roots"), F.col("n_paths").cast("bigint").alias("n_paths"), (F.col("status") == "on_cycle").alias("on_cycle"))


_LINKS = r"""
c AS (SELECT DISTINCT x.r, trim(x.c.claim_id, e' \t\n\r') AS id, x.c.parent_ids AS ps FROM (SELECT record_id AS r, unnest(claims) AS c FROM demo_records) x WHERE x.c.claim_id IS NOT NULL),
k AS (SELECT DISTINCT r, id FROM c),
e AS (SELECT DISTINCT a.r, a.id AS child, k.id AS parent FROM (SELECT r, id, trim(unnest(ps), e' \t\n\r') AS p FROM c) a JOIN k ON a.r = k.r AND a.p = k.id),
w AS (SELECT r, child AS s, parent AS v FROM e UNION SELECT w.r, w.s, e.parent FROM w JOIN e ON w.r = e.r AND w.v = e.child)
"""

PLACES = f"""{_LINKS},
cyc AS (SELECT DISTINCT r, s FROM w WHERE s = v),
bad AS (SELECT r, s FROM cyc UNION SELECT w.r, w.s FROM w JOIN cyc ON w.r = cyc.r AND w.v = cyc.s),
above AS (SELECT r, s FROM cyc UNION SELECT w.r, w.v FROM w JOIN cyc ON w.r = cyc.r AND w.s = cyc.s),
good AS (SELECT k.r, k.id FROM k LEFT JOIN bad ON bad.r = k.r AND bad.s = k.id WHERE bad.s IS NULL),
p AS (SELECT g.r, g.id, g.id AS root, g.id AS path, 0 AS d FROM good g LEFT JOIN e ON e.r = g.r AND e.child = g.id WHERE e.child IS NULL
      UNION ALL SELECT p.r, e.child, p.root, p.path || ' > ' || e.child, p.d + 1 FROM p JOIN e ON e.r = p.r AND e.parent = p.id JOIN good g ON g.r = e.r AND g.id = e.child),
t AS (SELECT r, id, max(d) AS depth, string_agg(DISTINCT root, ' | ' ORDER BY root) AS roots, string_agg(path, ' | ' ORDER BY path) AS paths FROM p GROUP BY r, id),
d AS (SELECT r, v AS id, string_agg(DISTINCT s, ' | ' ORDER BY s) AS ds, count(DISTINCT s) AS n FROM w GROUP BY r, v),
firm AS (SELECT k.r, k.id FROM k LEFT JOIN above a ON a.r = k.r AND a.s = k.id WHERE a.s IS NULL),
h AS (SELECT f.r, f.id, 0 AS h FROM firm f LEFT JOIN e ON e.r = f.r AND e.parent = f.id WHERE e.parent IS NULL
      UNION SELECT h.r, e.parent, h.h + 1 FROM h JOIN e ON e.r = h.r AND e.child = h.id JOIN firm f ON f.r = e.r AND f.id = e.parent),
hh AS (SELECT r, id, max(h) AS height FROM h GROUP BY r, id)"""

QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p1_hierarchy": p1_hierarchy, "p1_parents": p1_parents, "p1_edges": p1_edges, "p1_descendants": p1_descendants}

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT r AS record_id, s AS claim_id FROM w WHERE s = v",
    "p1_summary": f"""WITH RECURSIVE {_LINKS},
cyc AS (SELECT DISTINCT r, s FROM w WHERE s = v),
bad AS (SELECT r, s FROM cyc UNION SELECT w.r, w.s FROM w JOIN cyc ON w.r = cyc.r AND w.v = cyc.s),
good AS (SELECT k.r, k.id FROM k LEFT JOIN bad ON bad.r = k.r AND bad.s = k.id WHERE bad.s IS NULL),
p AS (SELECT g.r, g.id, g.id AS root, 0 AS d FROM good g LEFT JOIN e ON e.r = g.r AND e.child = g.id WHERE e.child IS NULL
      UNION ALL SELECT p.r, e.child, p.root, p.d + 1 FROM p JOIN e ON e.r = p.r AND e.parent = p.id JOIN good g ON g.r = e.r AND g.id = e.child),
t AS (SELECT r, id, max(d) AS depth, count(DISTINCT root) AS n_roots, count(*) AS n_paths FROM p GROUP BY r, id),
d AS (SELECT r, v AS id, count(DISTINCT s) AS n FROM w GROUP BY r, v)
SELECT k.r AS record_id, k.id AS claim_id, t.depth::BIGINT AS depth, coalesce(d.n, 0)::BIGINT AS n_descendants, coalesce(t.n_roots, -1)::BIGINT AS n_roots, t.n_paths::BIGINT AS n_paths, cyc.s IS NOT NULL AS on_cycle
FROM k LEFT JOIN t ON t.r = k.r AND t.id = k.id LEFT JOIN d ON d.r = k.r AND d.id = k.id LEFT JOIN cyc ON cyc.r = k.r AND cyc.s = k.id""",
    "p1_hierarchy": f"""WITH RECURSIVE {PLACES}
SELECT k.r AS record_id, k.id AS claim_id, CASE WHEN cyc.s IS NOT NULL THEN 'on_cycle' WHEN bad.s IS NOT NULL THEN 'below_cycle' WHEN above.s IS NOT NULL THEN 'above_cycle' ELSE 'ok' END AS status,
 t.depth::BIGINT AS depth, t.roots AS roots, t.paths AS paths, coalesce(d.ds, '') AS descendants
FROM k LEFT JOIN t ON t.r = k.r AND t.id = k.id LEFT JOIN d ON d.r = k.r AND d.id = k.id LEFT JOIN cyc ON cyc.r = k.r AND cyc.s = k.id LEFT JOIN bad ON bad.r = k.r AND bad.s = k.id LEFT JOIN above ON above.r = k.r AND above.s = k.id""",
    "p1_parents": f"WITH RECURSIVE {_LINKS} SELECT r AS record_id, child AS claim_id, parent FROM e",
    "p1_edges": f"""WITH RECURSIVE {PLACES}
SELECT k.r || ':' || k.id AS node, hh.height::INT AS height, t.depth::INT AS depth, (t.depth + 1)::INT AS path_length, CASE WHEN hh.height IS NOT NULL THEN coalesce(d.n, 0)::BIGINT END AS n_descendants, hh.height IS NULL AS in_cycle_part
FROM k LEFT JOIN t ON t.r = k.r AND t.id = k.id LEFT JOIN d ON d.r = k.r AND d.id = k.id LEFT JOIN hh ON hh.r = k.r AND hh.id = k.id""",
    "p1_descendants": f"WITH RECURSIVE {PLACES} SELECT DISTINCT w.r || ':' || w.v AS node, w.r || ':' || w.s AS descendant FROM w JOIN firm ON firm.r = w.r AND firm.id = w.v",
}
