"""Data contracts: checks that raise, reports that count, and quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normcast.functions.scalar import missing


class ContractError(ValueError):
    """A table breaks its contract."""


def _floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def absent(df: DataFrame, name: str) -> Column:
    return missing(F.col(f"`{name}`"), _floating(df, name))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Exact case: Spark itself would resolve names without it."""
    if lacking := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(lacking)}")


def check_contract(df: DataFrame, required: Sequence[str], label: str) -> None:
    """Columns present, none of them null or NaN, label 0 or 1 (numbers or booleans): errors in this order.

    One aggregate action. A table without rows passes.
    """
    require_columns(df, required)
    kind = df.schema[label].dataType
    binary = F.lit(isinstance(kind, (T.NumericType, T.BooleanType)))
    if isinstance(kind, T.NumericType):
        binary = F.col(f"`{label}`").isin(0, 1)
    elif isinstance(kind, T.BooleanType):
        binary = F.lit(True)
    found = df.agg(*[F.coalesce(F.max(absent(df, n)), F.lit(False)).alias(f"n{i}") for i, n in enumerate(required)], F.coalesce(F.min(binary), F.lit(True)).alias("binary")).first()
    if empty := [n for i, n in enumerate(required) if found[f"n{i}"]]:
        raise ContractError(f"null values in: {', '.join(empty)}")
    if not found["binary"]:
        bad = [r[0] for r in df.select(label).distinct().limit(10).collect()]
        raise ContractError(f"{label} must be 0 or 1; has {sorted(map(str, bad))}")


def report(df: DataFrame, id_col: str, columns: Sequence[str], label: Column) -> DataFrame:
    """One row: rows, distinct ids, missing values by column, smallest and largest label."""
    counts = [F.count_if(absent(df, c)).alias(f"missing_{c}") for c in columns]
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(id_col).alias("n_ids"), *counts, F.min(label).alias("min_label"), F.max(label).alias("max_label"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with ``reasons``: the names of rules that do not hold (a null outcome doesn't)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def conforms(df: DataFrame, schema: T.StructType) -> list[str]:
    """Differences of names and types from a wanted schema; none: it conforms."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {have.get(f.name, 'absent')} is not {f.dataType}" for f in schema if have.get(f.name) != f.dataType]


def cleaned(df: DataFrame, *, fill: Mapping[str, object] | None = None, cast: Mapping[str, str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Casts that give null on failure, then fills, then one row for each key."""
    for name, kind in (cast or {}).items():
        df = df.withColumn(name, F.col(name).try_cast(kind))
    if fill:
        df = df.fillna(dict(fill))
    return df.dropDuplicates(list(keys)) if keys else df


def out_of_order(df: DataFrame, time_col: str, id_col: str, by: Sequence[str]) -> DataFrame:
    """By partition of ``by``: rows whose time is before that of the row with the next lower id."""
    before = F.lag(time_col).over(Window.partitionBy(*by).orderBy(id_col))
    return df.withColumn("late", (F.col(time_col) < before).cast("int")).groupBy(*by).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("n_late"))


def population_stability(df: DataFrame, value: str, reference: Column, bins: int = 10) -> DataFrame:
    """PSI between reference rows and the rest over equal-width bins of the reference's range, with one added to each count."""
    edges = df.agg(F.min(F.when(reference, F.col(value))).alias("lo"), F.max(F.when(reference, F.col(value))).alias("hi"))
    place = F.least(F.greatest(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1))
    counts = df.withColumn("is_reference", reference).crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count_if(F.col("is_reference")).alias("a"), F.count_if(~F.col("is_reference")).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    counts = F.broadcast(every).join(counts, "bin", "left").fillna(0, ["a", "b"])
    all_ = Window.partitionBy()
    p, q = (F.col("a") + 1) / (F.sum("a").over(all_) + bins), (F.col("b") + 1) / (F.sum("b").over(all_) + bins)
    return counts.select(((p - q) * F.log(p / q)).alias("part")).agg(F.sum("part").alias("psi"))
