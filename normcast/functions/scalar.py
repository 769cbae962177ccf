"""Scalar expressions: each takes and returns columns, stays in the JVM and needs no UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(x: Column, floating: bool = True) -> Column:
    """Null or NaN."""
    return x.isNull() | F.isnan(x) if floating else x.isNull()


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def signed_log(x: Column) -> Column:
    """log1p of the magnitude with the sign of x."""
    return F.signum(x) * F.log1p(F.abs(x))


def hour_of_day(seconds: Column) -> Column:
    """Fractional hour of the day of elapsed seconds."""
    return F.pmod(seconds.cast("double") / 3600, F.lit(24.0))


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge that is at or over x; the number of edges if none is; null of null."""
    tests = [(x <= F.lit(float(e)), i) for i, e in enumerate(edges)]
    out = reduce(lambda acc, t: F.when(t[0], t[1]).otherwise(acc), reversed(tests), F.lit(len(edges)))
    return F.when(x.isNotNull(), out)


def equal_width_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """Right-closed bin 0..n-1 of equal width between low and high; the lowest value falls into the first."""
    place = F.ceil(ratio(x - low, high - low) * n) - 1
    return F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(n - 1)).cast("int")


def left_closed_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """Histogram bin 0..n-1; the highest value falls into the last."""
    return F.least(F.floor(F.coalesce(ratio(x - low, high - low), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")


def replaced(x: Column, groups: Mapping[str, Sequence[str]], other: str | None = None) -> Column:
    """Many names to one; names of no group stay, or become ``other``."""
    out = x if other is None else F.lit(other)
    for name, members in groups.items():
        out = F.when(x.isin(*members), F.lit(name)).otherwise(out)
    return out


def coded(x: Column, codes: Mapping[str, int], default: int = 0) -> Column:
    """Code of a name; ``default`` for others and null."""
    pairs = [F.lit(v) for kv in codes.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(x, F.lit(""))), F.lit(default))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def from_signed_prediction(p: Column) -> Column:
    """-1 (outlier) and 1 (inlier) to 1 and 0."""
    return F.when(p == -1, 1).otherwise(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return ratio(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.transform(a, lambda v: F.coalesce(F.try_divide(v.cast("double"), norm(a)), F.lit(0.0)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)


def mean_squared_error(a: Column, b: Column) -> Column:
    return ratio(squared_distance(a, b), F.size(a))


def salted_rank_key(id_: Column, seed: int) -> Column:
    """A pseudo-random order of ids that every engine repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))
