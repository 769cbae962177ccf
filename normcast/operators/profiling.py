"""Profiles: balance, shape and histograms of columns, one pass each where the statistic allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normcast.functions.scalar import left_closed_bin, ratio
from normcast.operators.ordered import percentiles


def class_balance(df: DataFrame, label: Column) -> DataFrame:
    """By label: rows, percent of all, and positives over negatives (not over all rows)."""
    counts = df.groupBy(label.cast("int").alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    ones, zeros = F.sum(F.when(F.col("label") == 1, F.col("n"))).over(every), F.sum(F.when(F.col("label") == 0, F.col("n"))).over(every)
    return counts.select("label", "n", (100.0 * F.col("n") / F.sum("n").over(every)).alias("percent"), ratio(ones, zeros).alias("contamination"))


def corrected_skewness(x: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null for under three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def skewness_profile(df: DataFrame, columns: Sequence[str], after: dict[str, Column]) -> DataFrame:
    """``(feature, before, after)``: skewness of columns and of what becomes of them, from one aggregate."""
    wide = df.agg(*[corrected_skewness(F.col(c)).alias(f"b{i}") for i, c in enumerate(columns)], *[corrected_skewness(after[c]).alias(f"a{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, n)`` of equal-width bins between the least and the greatest value; only bins with rows."""
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return df.select(column).filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(left_closed_bin(F.col(column), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def over_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the exact percentile and how many values are over it."""
    (cut,) = percentiles(df, column, [q])
    return df.agg(F.lit(cut).cast("double").alias("threshold"), F.count_if(F.col(column) > F.lit(cut)).alias("n_over"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n, mean, std, std_population, min, median, max)`` from one aggregate, and the medians from histograms."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "std_population": F.stddev_pop, "min": F.min, "max": F.max}
    middle = {c: F.lit(percentiles(df, c, [0.5])[0]).cast("double") for c in columns}
    wide = df.agg(*[f(F.col(c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{name}{i}").alias(name) for name in list(stats)[:5]], middle[c].alias("median"), F.col(f"max{i}").alias("max")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))
