"""Normalisation of nested records, their reference graphs, and validation as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import cache_identifier, clean_parents, code_levels, label, split_name, strip
from treeloom.operators.delivery import first_delivery
from treeloom.operators.hierarchy import forest_summary, node_depths


class RecordError(ValueError):
    """A strict check found violations."""


def normalize_records(df: DataFrame, key: str = "record_id", with_text: bool = True) -> DataFrame:
    """One row per delivered record: key, patent_id, split, source, section, class, subclass and the cleaned claims.

    Claims keep their order; each has position, id (stripped), text (null becomes empty, stripped) and parents
    (stripped, blanks dropped, repeats dropped keeping the first).  Null claims become an empty array.  Without
    ``with_text`` the texts are neither read nor shuffled.
    """
    if not with_text:
        df = df.withColumn("_ids", F.col("claims.claim_id")).withColumn("_parents", F.col("claims.parent_ids"))
        df = df.select(*[c for c in df.columns if c not in ("claims", "_ids", "_parents")], F.arrays_zip(F.col("_ids").alias("claim_id"), F.col("_parents").alias("parent_ids")).alias("claims"))
    once = first_delivery(df, key)

    def cleaned(c: Column, i: Column) -> Column:
        text = [strip(F.coalesce(c.text, F.lit(""))).alias("text")] if with_text else []
        return F.struct(i.cast("bigint").alias("claim_pos"), strip(c.claim_id).alias("claim_id"), *text, clean_parents(c.parent_ids).alias("parent_ids"))

    claims = F.transform(F.coalesce("claims", F.array().cast(df.schema["claims"].dataType)), cleaned)
    return once.select(key, strip("patent_id").alias("patent_id"), split_name("split").alias("split"), "source", label("cpc.section").alias("section"), label("cpc.class").alias("class"), label("cpc.subclass").alias("subclass"), claims.alias("claims"))


def explode_claims(records: DataFrame, key: str = "record_id") -> DataFrame:
    return records.select(key, F.inline("claims"))


def edges(claims: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, child_id, parent_id, parent_ord) of every named parent, known or not."""
    return claims.filter("claim_id is not null").select(key, F.col("claim_id").alias("child_id"), F.posexplode("parent_ids").alias("parent_ord", "parent_id")).withColumn("parent_ord", F.col("parent_ord").cast("bigint"))


def duplicate_claims(claims: DataFrame, key: str = "record_id") -> DataFrame:
    return claims.filter("claim_id is not null").groupBy(key, "claim_id").agg(F.count("*").alias("n")).filter("n > 1")


def invalid_references(claims: DataFrame, key: str = "record_id") -> DataFrame:
    """Named parents that are no claim of the record, distinct."""
    known = claims.select(F.col(key), F.col("claim_id").alias("parent_id"))
    return edges(claims, key).join(known, [key, "parent_id"], "left_anti").select(key, "child_id", "parent_id").distinct()


def self_references(claims: DataFrame, key: str = "record_id") -> DataFrame:
    return edges(claims, key).filter("child_id = parent_id").select(key, F.col("child_id").alias("claim_id")).distinct()


def graph_validation(records: DataFrame, key: str = "record_id", remove_invalid: bool = False, require_acyclic: bool = True) -> DataFrame:
    """One row per record: n_claims, n_edges, n_roots, max_depth, n_invalid, n_self, has_cycle, is_valid.

    Edges to unknown claims and to the claim itself are left out of n_edges, n_roots, max_depth and has_cycle;
    self references always make a record invalid; max_depth is 0 where there is a cycle.  All in one scan:
    the graph of a record is peeled where it lies.
    """
    ids = F.transform("claims", lambda c: c.claim_id)
    items = F.transform(
        F.filter("claims", lambda c: c.claim_id.isNotNull()),
        lambda c: F.struct(c.claim_id.alias("claim_id"), F.filter(F.array_intersect(c.parent_ids, ids), lambda p: p != c.claim_id).alias("parents"), F.size(F.array_except(c.parent_ids, ids)).alias("unknown"), F.array_contains(c.parent_ids, c.claim_id).cast("int").alias("itself")),
    )
    total = lambda name: F.aggregate("items", F.lit(0), lambda s, x: s + x[name]).cast("bigint")
    base = records.select(key, items.alias("items")).select(key, "items", total("unknown").alias("n_invalid"), total("itself").alias("n_self"))
    out = forest_summary(base, "items", "claim_id", "parents")
    valid = (F.col("n_self") == 0) & (F.lit(remove_invalid) | (F.col("n_invalid") == 0)) & (F.lit(not require_acyclic) | ~F.col("has_cycle")) & (F.col("n_roots") > 0)
    depth = F.when(F.col("has_cycle"), F.lit(0)).otherwise(F.greatest("max_depth", F.lit(0))).cast("bigint").alias("max_depth")
    return out.select(key, F.col("n_nodes").alias("n_claims"), F.col("n_links").alias("n_edges"), "n_roots", depth, "n_invalid", "n_self", "has_cycle", valid.alias("is_valid"))


def claim_depths(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, claim_id, depth, is_root): longest-path depth of every claim that neither lies on nor below a cycle."""
    nodes = node_depths(records, key, "claims", "claim_id", "parent_ids")
    return nodes.filter("depth is not null").select(key, F.col("node").alias("claim_id"), "depth", (F.col("depth") == 0).alias("is_root"))


def shuffled_depths(depths: DataFrame, key: str = "record_id", seed: int = 42) -> DataFrame:
    """Permute the positive depths within each record by the order of md5(seed:claim_id); roots keep theirs."""
    from pyspark.sql import Window

    roots = depths.filter("depth = 0").select(key, "claim_id", "depth")
    rest = depths.filter("depth > 0")
    a = rest.select(key, "claim_id", F.row_number().over(Window.partitionBy(key).orderBy("claim_id")).alias("k"))
    b = rest.select(key, "depth", F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("claim_id"))), "claim_id")).alias("k"))
    return roots.unionByName(a.join(b, [key, "k"]).select(key, "claim_id", "depth"))


def dataset_summary(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One row: records, claims, edges as given, roots, greatest depth, distinct labels of each level."""
    given = F.aggregate("claims", F.lit(0), lambda s, c: s + F.size(c.parent_ids)).cast("bigint")
    told = forest_summary(records.select("section", "class", "subclass", "claims", F.size("claims").cast("bigint").alias("n_given"), given.alias("n_edges")), "claims", "claim_id", "parent_ids")
    most = lambda c: F.coalesce(F.greatest(F.max(c), F.lit(0)), F.lit(0)).cast("bigint")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return told.agg(F.count("*").alias("n_records"), whole("n_given").alias("n_claims"), whole("n_edges").alias("n_edges"), F.countDistinct("section").alias("n_sections"), F.countDistinct("class").alias("n_classes"), F.countDistinct("subclass").alias("n_subclasses"), whole("n_roots").alias("n_roots"), most("max_depth").alias("max_depth"))


def claim_count_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy(F.size("claims").cast("bigint").alias("n_claims")).agg(F.count("*").alias("n_records"))


def legacy_violations(df: DataFrame, levels: tuple[str, ...] = ("section", "class", "subclass")) -> DataFrame:
    """(rule, n): legacy records without an identifier or a label of a level, and identifiers beyond their first row."""
    name = cache_identifier(F.col("patent_id"))
    told = df.agg(F.count_if(name.isNull()).alias("no_identifier"), *[F.count_if(label(c).isNull()).alias(f"no_{c}") for c in levels], (F.count(name) - F.countDistinct(name)).alias("repeated"))
    return told.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in told.columns])).alias("e")).select("e.rule", "e.n")


def read_legacy(df: DataFrame, expected: int | None = None) -> DataFrame:
    """Legacy records as they must be: of the ``expected`` number, each with an identifier of its own and all labels; else a ``RecordError``."""
    if expected is not None and (n := df.count()) != expected:
        raise RecordError(f"expected {expected} records, found {n}")
    require_empty(legacy_violations(df).filter("n > 0"), "legacy records")
    return df


def evaluation_records(df: DataFrame) -> DataFrame:
    """(patent_id, cpc struct<section, class, subclass>) of flat records; a missing identifier or label raises a ``RecordError``."""
    out = df.select(cache_identifier(F.col("patent_id")).alias("patent_id"), F.struct(*[label(c).alias(c) for c in ("section", "class", "subclass")]).alias("cpc"))
    require_empty(out.filter("patent_id is null or cpc.section is null or cpc.class is null or cpc.subclass is null"), "records without identifier or label")
    return out


def code_record(df: DataFrame, code: str) -> DataFrame:
    return df.withColumn("levels", code_levels(F.col(code)))


def require_empty(violations: DataFrame, what: str, shown: int = 10) -> None:
    """Raise with the first violations, for callers that want to fail fast."""
    rows = violations.limit(shown).collect()
    if rows:
        raise RecordError(f"{what}: " + "; ".join(str(tuple(r)) for r in rows))
