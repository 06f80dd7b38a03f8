"""Column expressions on vectors held as arrays of numbers; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def is_finite(v: Column) -> Column:
    """True if every number is there, no NaN and not infinite; null vectors give null."""
    return F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def l2(v: Column, eps: float = EPS, strict: bool = False) -> Column:
    """The unit vector; null where the norm is at most ``eps`` (below it with ``strict``: the reduction layer's rule)."""
    n = norm(v)
    fine = (n >= eps) if strict else (n > eps)
    return F.when(fine, F.transform(as_double(v), lambda x: x / n))


def valid(v: Column, dim: int | None = None, eps: float = EPS) -> Column:
    """Not null, finite, not empty, of length ``dim`` if given, and not (nearly) zero.  Never null."""
    ok = v.isNotNull() & (F.size(v) > 0) & is_finite(v) & (norm(v) > eps)
    if dim is not None:
        ok = ok & (F.size(v) == dim)
    return F.coalesce(ok, F.lit(False))


def row_mean(rows: Column, width: Column) -> Column:
    """Mean vector of an array of vectors, each of length ``width``; null for no rows."""
    dims = F.sequence(F.lit(0), width - 1)
    return F.when(F.size(rows) > 0, F.transform(dims, lambda d: F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.get(r, d).cast("double")) / F.size(rows)))


def truncated_mean(rows: Column, number: Column) -> Column:
    """Mean of the first ``number`` rows (all that are stored, where there are fewer or number is null); null for none."""
    kept = F.slice(rows, 1, F.greatest(F.lit(0), F.least(F.coalesce(number, F.size(rows)), F.size(rows))))
    return F.when(F.size(rows) > 0, row_mean(kept, F.size(F.get(rows, F.lit(0)))))


def masked_mean(rows: Column, mask: Column) -> Column:
    """Mean of rows weighted by a non-negative mask of the same length; null if a mask is negative or sums to nothing."""
    total = F.aggregate(mask, F.lit(0.0), lambda s, x: s + x)
    fine = (F.size(rows) == F.size(mask)) & (total > 0) & F.forall(mask, lambda m: m >= 0)
    dims = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1)
    pairs = F.arrays_zip(rows.alias("r"), mask.alias("m"))
    return F.when(fine, F.transform(dims, lambda d: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(p["m"] > 0, F.get(p["r"], d).cast("double") * p["m"]).otherwise(0.0)) / total))
