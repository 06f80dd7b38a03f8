"""Normalisation, graph validation, depths and summaries of demo_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.text import alnum_key, cache_identifier, code_levels, label, strict_identifier
from treeloom.operators import records as R
from treeloom.operators.checks import missing_labels as count_missing
from treeloom.operators.experiments import tune_holdout


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/demo_records.parquet")


def _records(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    return R.normalize_records(_raw(spark, sf_dir), with_text=with_text)


def _claims(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    return R.explode_claims(_records(spark, sf_dir, with_text))


def records_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("record_id", "patent_id", "split", "source", "section", "class", "subclass", F.size("claims").cast("bigint").alias("n_claims"))


def claims_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, with_text=True).select("record_id", "claim_pos", "claim_id", F.md5("text").alias("text_md5"), F.size("parent_ids").cast("bigint").alias("n_parents"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edges(_claims(spark, sf_dir))


def claim_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.claim_count_distribution(_records(spark, sf_dir))


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dataset_summary(_records(spark, sf_dir))


def violations_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_claims(_claims(spark, sf_dir))


def violations_duplicate_patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(alnum_key("patent_id").alias("patent_key")).filter("patent_key is not null").groupBy("patent_key").agg(F.count("*").alias("n")).filter("n > 1")


def violations_invalid_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.invalid_references(_claims(spark, sf_dir))


def violations_self_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.self_references(_claims(spark, sf_dir))


def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graph_validation(_records(spark, sf_dir))


def graph_validation_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.graph_validation(_records(spark, sf_dir), remove_invalid=True, require_acyclic=False)


def claim_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.claim_depths(_records(spark, sf_dir))


def shuffled_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shuffled_depths(R.claim_depths(_records(spark, sf_dir)))


def cpc_from_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("record_id", code_levels(F.col("subclass")).alias("l")).select("record_id", "l.section", "l.class", "l.subclass")


def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_missing(_raw(spark, sf_dir).select("cpc.section", "cpc.class", "cpc.subclass"), ("section", "class", "subclass"))


def identifier_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both identifier rules on patent ids and on numbers written as text."""
    df = _raw(spark, sf_dir)
    both = df.select("record_id", F.explode(F.array("patent_id", F.concat(F.col("record_id").cast("string"), F.lit(".0")))).alias("raw")).distinct()
    return both.select("record_id", "raw", strict_identifier(F.col("raw")).alias("strict_id"), cache_identifier(F.col("raw")).alias("cache_id"))


def label_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/patent_labels.parquet").select("global_index", label("section").alias("section"), label("class").alias("class"), label("subclass").alias("subclass"))


def tune_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune_holdout(spark.read.parquet(f"{sf_dir}/patent_labels.parquet").select("global_index"), "global_index")


#: The characters with Unicode's White_Space property, for trim().
_T = " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_BASE = rf"""
r AS (SELECT record_id, any_value(patent_id) AS patent_id, any_value(split) AS split, any_value(source) AS source, any_value(cpc) AS cpc, coalesce(any_value(claims), []) AS claims FROM demo_records GROUP BY record_id),
c AS (SELECT record_id, (i - 1)::BIGINT AS claim_pos, trim(claims[i].claim_id, {_T}) AS claim_id, trim(coalesce(claims[i].text, ''), {_T}) AS text, coalesce(claims[i].parent_ids, []) AS ps FROM (SELECT record_id, claims, unnest(range(1, len(claims) + 1)) AS i FROM r)),
p0 AS (SELECT record_id, claim_pos, claim_id, trim(ps[j], {_T}) AS parent_id, j FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM c)),
p AS (SELECT record_id, claim_pos, claim_id, parent_id, row_number() OVER (PARTITION BY record_id, claim_pos ORDER BY min(j)) - 1 AS parent_ord FROM p0 WHERE parent_id <> '' GROUP BY record_id, claim_pos, claim_id, parent_id),
k AS (SELECT DISTINCT record_id, claim_id FROM c WHERE claim_id IS NOT NULL)
"""
_GRAPH = (
    _BASE
    + """,
e AS (SELECT DISTINCT p.record_id, p.claim_id AS child, p.parent_id AS parent FROM p JOIN k ON k.record_id = p.record_id AND k.claim_id = p.parent_id),
x AS (SELECT * FROM e WHERE child <> parent),
w AS (SELECT record_id, child AS s, parent AS v FROM x UNION SELECT w.record_id, w.s, x.parent FROM w JOIN x ON x.record_id = w.record_id AND x.child = w.v),
cyc AS (SELECT DISTINCT record_id, s FROM w WHERE s = v),
full_w AS (SELECT record_id, child AS s, parent AS v FROM e UNION SELECT f.record_id, f.s, e.parent FROM full_w f JOIN e ON e.record_id = f.record_id AND e.child = f.v),
on_cycle AS (SELECT DISTINCT record_id, s FROM full_w WHERE s = v),
bad AS (SELECT record_id, s FROM on_cycle UNION SELECT f.record_id, f.s FROM full_w f JOIN on_cycle o ON o.record_id = f.record_id AND o.s = f.v),
d0 AS (SELECT k.record_id, k.claim_id, 0 AS depth FROM k LEFT JOIN e ON e.record_id = k.record_id AND e.child = k.claim_id WHERE e.child IS NULL
       UNION SELECT d0.record_id, e.child, d0.depth + 1 FROM d0 JOIN e ON e.record_id = d0.record_id AND e.parent = d0.claim_id LEFT JOIN bad ON bad.record_id = e.record_id AND bad.s = e.child WHERE bad.s IS NULL),
depth AS (SELECT record_id, claim_id, max(depth)::BIGINT AS depth FROM d0 GROUP BY record_id, claim_id),
d1 AS (SELECT k.record_id, k.claim_id, 0 AS depth FROM k LEFT JOIN x ON x.record_id = k.record_id AND x.child = k.claim_id WHERE x.child IS NULL AND k.record_id NOT IN (SELECT record_id FROM cyc)
       UNION SELECT d1.record_id, x.child, d1.depth + 1 FROM d1 JOIN x ON x.record_id = d1.record_id AND x.parent = d1.claim_id)
"""
)


def _validation(remove: str, acyclic: str) -> str:
    return f"""WITH RECURSIVE {_GRAPH}
SELECT r.record_id, coalesce(n.n, 0)::BIGINT AS n_claims, coalesce(m.n, 0)::BIGINT AS n_edges, coalesce(t.n, 0)::BIGINT AS n_roots,
 coalesce(d.m, 0)::BIGINT AS max_depth, coalesce(i.n, 0)::BIGINT AS n_invalid, coalesce(s.n, 0)::BIGINT AS n_self, cy.record_id IS NOT NULL AS has_cycle,
 coalesce(s.n, 0) = 0 AND ({remove} OR coalesce(i.n, 0) = 0) AND ({acyclic} OR cy.record_id IS NULL) AND coalesce(t.n, 0) > 0 AS is_valid
FROM r LEFT JOIN (SELECT record_id, count(*) AS n FROM k GROUP BY 1) n USING (record_id)
LEFT JOIN (SELECT record_id, count(*) AS n FROM x GROUP BY 1) m USING (record_id)
LEFT JOIN (SELECT k.record_id, count(*) AS n FROM k LEFT JOIN x ON x.record_id = k.record_id AND x.child = k.claim_id WHERE x.child IS NULL GROUP BY 1) t USING (record_id)
LEFT JOIN (SELECT record_id, max(depth) AS m FROM d1 GROUP BY 1) d USING (record_id)
LEFT JOIN (SELECT p.record_id, count(*) AS n FROM p LEFT JOIN k ON k.record_id = p.record_id AND k.claim_id = p.parent_id WHERE k.claim_id IS NULL AND p.claim_id IS NOT NULL GROUP BY 1) i USING (record_id)
LEFT JOIN (SELECT record_id, count(*) AS n FROM p WHERE claim_id = parent_id GROUP BY 1) s USING (record_id)
LEFT JOIN (SELECT DISTINCT record_id FROM cyc) cy USING (record_id)"""


def _label(c: str) -> str:
    return f"nullif(trim({c}, {_T}), '')"


_CODE = f"upper({_label('r.cpc.subclass')})"

QUERIES = {
    f.__name__: f
    for f in (records_normalized, claims_exploded, edges, claim_count_distribution, dataset_summary, violations_duplicate, violations_duplicate_patents, violations_invalid_ref, violations_self_ref, graph_validation, graph_validation_lenient, claim_depth, shuffled_depths, cpc_from_code, missing_labels, identifier_normalization, label_normalization, tune_holdout_split)
}
ORACLES = {
    "records_normalized": f"WITH {_BASE} SELECT record_id, trim(patent_id, {_T}) AS patent_id, lower({_label('split')}) AS split, source, {_label('cpc.section')} AS section, {_label('cpc.class')} AS class, {_label('cpc.subclass')} AS subclass, len(claims)::BIGINT AS n_claims FROM r",
    "claims_exploded": f"WITH {_BASE} SELECT c.record_id, c.claim_pos, c.claim_id, md5(c.text) AS text_md5, count(p.parent_id) AS n_parents FROM c LEFT JOIN p ON p.record_id = c.record_id AND p.claim_pos = c.claim_pos GROUP BY 1, 2, 3, 4",
    "edges": f"WITH {_BASE} SELECT record_id, claim_id AS child_id, parent_id, parent_ord FROM p WHERE claim_id IS NOT NULL",
    "claim_count_distribution": f"WITH {_BASE} SELECT len(claims)::BIGINT AS n_claims, count(*) AS n_records FROM r GROUP BY 1",
    "dataset_summary": f"""WITH RECURSIVE {_GRAPH} SELECT (SELECT count(*) FROM r) AS n_records, (SELECT count(*) FROM c) AS n_claims, (SELECT count(*) FROM p) AS n_edges,
(SELECT count(DISTINCT {_label('cpc.section')}) FROM r) AS n_sections, (SELECT count(DISTINCT {_label('cpc.class')}) FROM r) AS n_classes, (SELECT count(DISTINCT {_label('cpc.subclass')}) FROM r) AS n_subclasses,
(SELECT count(*) FROM depth WHERE depth = 0) AS n_roots, (SELECT max(depth) FROM depth) AS max_depth""",
    "violations_duplicate": f"WITH {_BASE} SELECT record_id, claim_id, count(*) AS n FROM c WHERE claim_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "violations_duplicate_patents": f"WITH {_BASE} SELECT nullif(regexp_replace(upper(patent_id), '[^A-Z0-9]', '', 'g'), '') AS patent_key, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1 AND patent_key IS NOT NULL",
    "violations_invalid_ref": f"WITH {_BASE} SELECT DISTINCT p.record_id, p.claim_id AS child_id, p.parent_id FROM p LEFT JOIN k ON k.record_id = p.record_id AND k.claim_id = p.parent_id WHERE k.claim_id IS NULL AND p.claim_id IS NOT NULL",
    "violations_self_ref": f"WITH {_BASE} SELECT DISTINCT record_id, claim_id FROM p WHERE claim_id = parent_id",
    "graph_validation": _validation("false", "false"),
    "graph_validation_lenient": _validation("true", "true"),
    "claim_depth": f"WITH RECURSIVE {_GRAPH} SELECT record_id, claim_id, depth, depth = 0 AS is_root FROM depth",
    "shuffled_depths": f"""WITH RECURSIVE {_GRAPH},
a AS (SELECT record_id, claim_id, row_number() OVER (PARTITION BY record_id ORDER BY claim_id) AS n FROM depth WHERE depth > 0),
b AS (SELECT record_id, depth, row_number() OVER (PARTITION BY record_id ORDER BY md5('42:' || claim_id), claim_id) AS n FROM depth WHERE depth > 0)
SELECT record_id, claim_id, depth FROM depth WHERE depth = 0 UNION ALL SELECT a.record_id, a.claim_id, b.depth FROM a JOIN b ON a.record_id = b.record_id AND a.n = b.n""",
    "cpc_from_code": f"WITH {_BASE} SELECT record_id, {_CODE}[1:1] AS section, {_CODE}[1:3] AS class, {_CODE}[1:4] AS subclass FROM r",
    "missing_labels": "SELECT level, count(*) FILTER (WHERE v IS NULL OR trim(v) = '') AS n_missing FROM (SELECT unnest(['section', 'class', 'subclass']) AS level, unnest([cpc.section, cpc.class, cpc.subclass]) AS v FROM demo_records) GROUP BY 1",
    "identifier_normalization": f"""WITH b AS (SELECT DISTINCT record_id, unnest([patent_id, record_id::VARCHAR || '.0']) AS raw FROM demo_records), s AS (SELECT record_id, raw, {_label('raw')} AS strict_id FROM b)
SELECT record_id, raw, strict_id, CASE WHEN regexp_matches(strict_id, '^-*[0-9]+\\.0$') THEN regexp_replace(strict_id, '\\.0$', '') WHEN lower(strict_id) = 'nan' THEN NULL ELSE strict_id END AS cache_id FROM s""",
    "label_normalization": f"SELECT global_index, {_label('section')} AS section, {_label('class')} AS class, {_label('subclass')} AS subclass FROM patent_labels",
    "tune_holdout_split": "SELECT global_index, CASE WHEN ('0x' || md5('42:' || global_index::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.7 THEN 'tune' ELSE 'holdout' END AS part FROM patent_labels",
}
