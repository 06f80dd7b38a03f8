"""Column expressions for blanks, identifiers, labels and classification codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space in Java's notation, as surrounding blanks.
_BLANK = r"(?U)^\s+|(?U)\s+$"


def strip(c: Column | str) -> Column:
    """``c`` without surrounding white space of any kind; null stays null."""
    return F.regexp_replace(c, _BLANK, "")


def label(c: Column | str) -> Column:
    """A stripped label; blank and null become null."""
    s = strip(c)
    return F.when(s != "", s)


def strict_identifier(c: Column) -> Column:
    """Identifier of the graph layer: the stripped text of the value; null and blank become null."""
    return label(c.cast("string"))


def cache_identifier(c: Column) -> Column:
    """Identifier of the cached layer: as :func:`strict_identifier`, but an integral number written ``12.0`` becomes ``12``."""
    s = strict_identifier(c)
    return F.when(s.rlike(r"^-*[0-9]+\.0$"), F.regexp_replace(s, r"\.0$", "")).otherwise(F.when(F.lower(s) == "nan", F.lit(None)).otherwise(s))


def clean_parents(c: Column) -> Column:
    """Parents of one part: stripped, blanks and nulls dropped, repeats dropped keeping the first; null becomes empty."""
    stripped = F.transform(c, strip)
    kept = F.filter(stripped, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def code_levels(c: Column) -> Column:
    """A classification code as a struct: ``A61K`` gives section A, class A61, subclass A61K; upper-cased; blank gives nulls."""
    code = F.upper(label(c))
    return F.struct(
        F.substring(code, 1, 1).alias("section"),
        F.substring(code, 1, 3).alias("class"),
        F.substring(code, 1, 4).alias("subclass"),
    )


def code_levels_of_list(c: Column) -> Column:
    """:func:`code_levels` of the first code of a list that is not blank; null and empty lists give nulls."""
    return code_levels(F.get(F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != "")), F.lit(0)))


def alnum_key(c: Column | str) -> Column:
    """Upper-cased and reduced to A-Z and 0-9; null where nothing is left."""
    s = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(s != "", s)


def split_name(c: Column | str) -> Column:
    """A split's name without case and blanks; null where there is none."""
    return F.lower(label(c))
