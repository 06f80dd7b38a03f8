"""Readers with explicit schemas: nested records, assignments, shards, settings and files."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIM = T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("parent_ids", T.ArrayType(T.StringType()))])
CPC = T.StructType([T.StructField("section", T.StringType()), T.StructField("class", T.StringType()), T.StructField("subclass", T.StringType())])
RECORD = T.StructType([T.StructField("patent_id", T.StringType()), T.StructField("claims", T.ArrayType(CLAIM)), T.StructField("cpc", CPC)])
ASSIGNMENT = T.StructType([T.StructField("global_index", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("patent_id", "section", "class", "subclass"))])
ENVELOPES = ("records", "data", "patents", "items")


LAYOUTS = ("auto", "lines", "whole")


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD, names: dict[str, str] | None = None, file_format: str = "json", layout: str = "auto") -> DataFrame:
    """Nested records from JSON or parquet.

    ``layout`` of JSON: ``lines`` has one object in each line, and its files are split among tasks; ``whole`` is an array, an object, or an object with
    the array under a known key, a task each; ``auto`` looks at the first line.  Malformed JSON raises an error when it is read.
    ``names`` maps fields of the schema to the names they have in the file, nested ones of claims included.
    """
    names = names or {}
    renamed = _renamed(schema, names)
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    if file_format == "parquet":
        df = spark.read.schema(renamed).parquet(path)
    elif file_format == "json":
        reader = spark.read.option("mode", "FAILFAST")
        if (_layout(spark, path) if layout == "auto" else layout) == "lines":
            df = reader.schema(renamed).json(path)
        else:
            raw = reader.schema(T.StructType([*renamed.fields, *(T.StructField(e, T.ArrayType(renamed)) for e in ENVELOPES)])).option("multiLine", True).json(path)
            row = F.struct(*[F.col(f.name) for f in renamed.fields])
            df = raw.select(F.explode(F.coalesce(*[F.col(e) for e in ENVELOPES], F.array(row))).alias("r")).select("r.*")
    else:
        raise ValueError("file_format must be json or parquet; pickled objects are code and are not read")
    return df.select(*[F.col(r.name).cast(f.dataType).alias(f.name) for f, r in zip(schema.fields, renamed.fields)])


def _layout(spark: SparkSession, path: str) -> str:
    """``lines`` if the first line that is not blank is a whole object without a known envelope."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    try:
        held = json.loads(first["value"]) if first else None
    except ValueError:
        return "whole"
    return "lines" if isinstance(held, dict) and not any(e in held for e in ENVELOPES) else "whole"


def _renamed(schema: T.StructType, names: dict[str, str]) -> T.StructType:
    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return _renamed(t, names)
        return T.ArrayType(kind(t.elementType)) if isinstance(t, T.ArrayType) else t

    return T.StructType([T.StructField(names.get(f.name, f.name), kind(f.dataType)) for f in schema.fields])


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSIGNMENT).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A result table in CSV with a header; text columns unless a schema is given."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_shards(spark: SparkSession, path: str, pattern: str = "*", expected: int | None = None, first: int | None = None) -> DataFrame:
    """Parquet shards below ``path`` whose file names match; ``expected`` asserts their number, ``first`` keeps the first by name."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path).withColumn("shard_file", F.col("_metadata.file_name"))
    if expected is None and first is None:
        return df
    files = list_files(spark, path, pattern).select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct().orderBy("name")
    if expected is not None and (found := files.count()) != expected:
        raise ValueError(f"expected {expected} shards, found {found}")
    return df if first is None else df.join(F.broadcast(files.limit(first)), F.col("shard_file") == F.col("name"), "left_semi")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of files below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def find_newest(spark: SparkSession, path: str, pattern: str, prefer: str = "") -> str | None:
    """The newest matching file, those with ``prefer`` in their path first."""
    row = list_files(spark, path, pattern).orderBy(F.desc(F.col("path").contains(prefer)), F.desc("modified"), "path").first()
    return row["path"] if row else None


def read_pool(spark: SparkSession, path: str, pool: str) -> DataFrame:
    """One pooled matrix of a table partitioned by pool: only its folder is read."""
    return spark.read.parquet(path).filter(F.col("pool") == pool)


def load_settings(path: str, strict_environment: bool = False, required: tuple[str, ...] = (), paths: tuple[str, ...] = (), kinds: dict[str, type | tuple[type, ...]] | None = None) -> dict:
    """A JSON object with ``${NAME}`` and ``${NAME:-default}`` expanded from the environment in all its strings.

    Keys may be dotted (``data.path``).  ``required`` keys must be there and not null; values under ``paths`` are resolved
    against the file's folder, unless they are absolute or URIs; ``kinds`` gives the types that values must have (a bool is no number).
    """
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    if not isinstance(settings, dict):
        raise ValueError("settings must be a JSON object")

    def expand(x: object) -> object:
        if isinstance(x, dict):
            return {k: expand(v) for k, v in x.items()}
        if isinstance(x, list):
            return [expand(v) for v in x]
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, x) if isinstance(x, str) else x

    def value(m: re.Match) -> str:
        found = os.environ.get(m[1], m[2])
        if found is None and strict_environment:
            raise KeyError(f"environment variable {m[1]} is not set")
        return m[0] if found is None else found

    settings = expand(settings)
    missing = [r for r in required if setting(settings, r) is None]
    if missing:
        raise ValueError(f"settings lack {', '.join(missing)}")
    wrong = [k for k, kind in (kinds or {}).items() if (v := setting(settings, k)) is not None and (not isinstance(v, kind) or isinstance(v, bool) and kind is not bool)]
    if wrong:
        raise ValueError(f"settings have the wrong type: {', '.join(wrong)}")
    base = os.path.dirname(os.path.abspath(path))
    for key in paths:
        held = setting(settings, key)
        if isinstance(held, str) and "://" not in held:
            *above, last = key.split(".")
            setting(settings, ".".join(above))[last] = os.path.normpath(os.path.join(base, os.path.expanduser(held)))
    return settings


def setting(settings: dict, key: str, default: object = None) -> object:
    """The value under a dotted key; the whole object under an empty one."""
    held: object = settings
    for part in key.split(".") if key else ():
        if not isinstance(held, dict) or part not in held:
            return default
        held = held[part]
    return held
