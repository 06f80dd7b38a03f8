"""Problem 8 over documents, common_words and doc_labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.quality import FEATURES, PUBLIC, document_statistics, not_prose


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part lists, tables or junk."""
    return not_prose(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "common_words"), _table(spark, sf_dir, "doc_labels")).select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count, mean word length, shares of symbols, of lines ending in punctuation and of common words of each document."""
    stats = document_statistics(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "common_words"))
    value = lambda k: F.round(F.col("x")[k], 6) + F.lit(0.0)
    return stats.select("doc_id", F.col("x")[0].cast("bigint").alias(FEATURES[0]), *(value(k).alias(FEATURES[k]) for k in range(1, len(PUBLIC))))


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}

_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SHARE = "round({0}::DOUBLE / greatest({1}, 1), 6) + 0.0"
ORACLES = {
    "p8_statistics": rf"""WITH c AS (SELECT list(DISTINCT lower(word)) AS c FROM common_words),
t AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[^{_SPACE}]') THEN text ELSE '' END AS t FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w, list_filter(list_transform(regexp_split_to_array(t, '{_BREAK}'), lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '') AS l FROM t)
SELECT doc_id, len(w)::BIGINT AS word_count, {_SHARE.format("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "len(w)")} AS mean_word_length,
 {_SHARE.format(f"length(regexp_replace(t, '[{chr(92)}p{{L}}{chr(92)}p{{N}}{_SPACE}]', '', 'g'))", "length(t)")} AS symbol_share,
 {_SHARE.format("len(list_filter(l, lambda x: contains('.!?…。！？:;”' || chr(34) || chr(39) || '»)', right(x, 1))))", "len(l)")} AS punct_line_share,
 {_SHARE.format("len(list_filter(w, lambda x: list_contains(c, x)))", "len(w)")} AS common_share FROM d, c""",
}
