"""Order statistics without one task that sees all rows: cut keys from histograms, running totals from bucket totals."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a histogram round: what the driver gets at most.
BUCKETS = 1 << 12


def kth_values(df: DataFrame, key: str, ks: Iterable[int]) -> dict[int, tuple]:
    """Of each k the k-th smallest (from 0) of a numeric column without nulls and NaN, the number of smaller rows and of
    equal ones: ``{k: (value, smaller, equal)}``, for the k that the column has.

    Each round counts rows in equal buckets of the ranges that are left, all k at once, and goes on in the boundary
    buckets, between the least and greatest value that these really have, until they hold one value.
    """
    n, low, high = df.agg(F.count(key), F.min(key), F.max(key)).first()
    x, done = F.col(key), {}
    left = {k: (low, high, 0, n) for k in ks if 0 <= k < n}
    while left:
        done |= {k: (lo, before, m) for k, (lo, hi, before, m) in left.items() if lo == hi}
        left = {k: r for k, r in left.items() if r[0] != r[1]}
        if not left:
            break
        ranges = sorted({(lo, hi, before) for lo, hi, before, _ in left.values()})
        which, place, inside = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
        for i, (lo, hi, _) in enumerate(ranges):
            part = (x.cast("double") / 2 - F.lit(float(lo) / 2)) / F.lit(float(hi) / 2 - float(lo) / 2 or 1.0)
            bucket = F.greatest(F.lit(0), F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)))
            # the ends stand apart, so that a round always narrows the range
            bucket = F.when(x == F.lit(lo), F.lit(-1)).when(x == F.lit(hi), F.lit(BUCKETS)).otherwise(bucket)
            within = (x >= F.lit(lo)) & (x <= F.lit(hi))
            which, place, inside = F.when(within, i).otherwise(which), F.when(within, bucket).otherwise(place), inside | within
        counted = df.filter(inside).groupBy(which.alias("i"), place.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("i", "b").collect()
        for k, (lo, hi, before, _) in left.items():
            for r in counted:
                if ranges[r["i"]] == (lo, hi, left[k][2]):
                    if before + r["n"] > k:
                        left[k] = (r["lo"], r["hi"], before, r["n"])
                        break
                    before += r["n"]
    return done


def kth_smallest(df: DataFrame, key: str, k: int):
    """The k-th smallest (from 0) of a numeric column without nulls and NaN, and the number of smaller rows."""
    return kth_values(df, key, [k])[k][:2]


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles of a numeric column, between two neighbours in proportion; nulls and NaN don't count, None without any value."""
    known = df.select(F.col(column).cast("double").alias("__x")).filter("__x IS NOT NULL AND NOT isnan(__x)")
    n = known.count()
    places = [q * (n - 1) for q in shares]
    found = kth_values(known, "__x", {k for p in places for k in (math.floor(p), math.ceil(p))}) if n else {}

    def between(p: float) -> float:
        low, high = found[math.floor(p)][0], found[math.ceil(p)][0]
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    return [between(p) if n else None for p in places]


def order_keys(df: DataFrame, name: str) -> list[Column]:
    """Whole or real numbers whose order, one after the other, is that of a column, missing values (NaN too) last.

    Strings are told apart by their first 28 bytes.
    """
    kind, x = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "string":
        raw = x.cast("binary")
        parts = [F.conv(F.hex(F.rpad(F.substring(raw, 7 * i + 1, 7), 7, F.lit(b"\x00"))), 16, 10).cast("long") for i in range(4)]
    elif kind.startswith("timestamp"):
        parts = [F.unix_micros(x.cast("timestamp"))]
    elif kind == "date":
        parts = [F.unix_date(x)]
    elif kind == "boolean":
        parts = [x.cast("int")]
    else:
        parts = [F.when(~F.isnan(x), x) if kind in ("double", "float") else x]
    return [parts[0].isNull().cast("int"), *[F.coalesce(p, F.lit(0)) for p in parts]]


def among_each(df: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> list[Column]:
    """Of each k whether a row is among the first k in order of the numeric, never missing keys: compared where it lies.

    Rows alike in all keys stay together. There must be as many rows. The k share their rounds as long as they lie among the same rows.
    """
    out, tied, left, path = [[x] * len(ks) for x in (F.lit(False), F.lit(True), 0, ())]
    left, rests = list(ks), {(): df}
    live = {i for i, k in enumerate(ks) if k > 0}
    for key in keys:
        found = {p: kth_values(rests[p], key, {left[i] - 1 for i in live if path[i] == p}) for p in {path[i] for i in live}}
        for i in sorted(live):
            value, smaller, equal = found[path[i]][left[i] - 1]
            at = F.col(key) == F.lit(value)
            out[i], tied[i], left[i] = out[i] | (tied[i] & (F.col(key) < F.lit(value))), tied[i] & at, left[i] - smaller
            if equal == left[i]:
                live.remove(i)
                continue
            before, path[i] = path[i], (*path[i], (key, value))
            rests.setdefault(path[i], rests[before].filter(at))
    return [o | t if k > 0 else F.lit(False) for o, t, k in zip(out, tied, ks)]


def among_first(df: DataFrame, keys: Sequence[str], k: int) -> Column:
    """``among_each`` of one k."""
    return among_each(df, keys, [k])[0]


def running_totals(df: DataFrame, key: str, sums: dict[str, str], descending: bool = True, buckets: int | None = None) -> DataFrame:
    """``df`` with running totals (with the row) of columns, ``{new: column}``, in order of a numeric key.

    Approximate quantiles deal rows into ranges of the key; a range's rows are summed in order within
    it, on top of the totals of the ranges before, of which there are ``buckets`` at most. Keys must
    differ from row to row, which a preceding aggregation by key makes sure of.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.01))) if buckets > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    dealt = df.withColumn("__range", place)
    totals = {r["__range"]: r for r in dealt.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()}
    places = range(len(bounds) + 1)
    before = {n: [] for n in sums}
    for n, out in before.items():
        so_far = 0
        for i in reversed(places) if descending else places:
            out.append(so_far)
            so_far += (totals[i][n] if i in totals else 0) or 0
    inside = Window.partitionBy("__range").orderBy(F.col(key).desc() if descending else F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    # the totals are looked up, not joined: a row for each range, of which there are few
    at = F.lit(len(bounds)) - F.col("__range") if descending else F.col("__range")
    return dealt.withColumns({n: F.sum(c).over(inside) + F.get(F.array(*map(F.lit, before[n])), at) for n, c in sums.items()}).select(*df.columns, *sums)
