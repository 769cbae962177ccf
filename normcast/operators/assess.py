"""From scores to levels, evidence, cases and decisions. Thresholds and rules are always arguments, under a version."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normcast.operators.quality import ContractError


#: Columns of the experiment log.
EXPERIMENT = ("id", "hypothesis", "dataset_version", "feature_version", "configuration", "seed", "environment", "metrics", "resources", "conclusion")


@dataclass(frozen=True)
class Policy:
    """Levels from the lowest, each with the score from which it holds; the first holds from any score on."""

    version: str
    steps: tuple[tuple[str, float], ...]

    def level(self, score: Column) -> Column:
        out = F.lit(self.steps[0][0])
        for name, least in self.steps[1:]:
            out = F.when(score >= least, F.lit(name)).otherwise(out)
        return F.when(score.isNotNull(), out)


def assessed(df: DataFrame, score: str, policy: Policy, out: str = "level") -> DataFrame:
    return df.withColumn(out, policy.level(F.col(score))).withColumn("policy_version", F.lit(policy.version))


def decisions(df: DataFrame, level: str, actions: dict[str, tuple[str, str]]) -> DataFrame:
    """``state`` and ``recommended_action`` of each level; a level without an entry has none."""
    rows = df.sparkSession.createDataFrame([(k, s, a) for k, (s, a) in actions.items()], "__l string, state string, recommended_action string")
    return df.join(F.broadcast(rows), F.col(level) == F.col("__l"), "left").drop("__l")


def evidence(df: DataFrame, id_col: str, columns: Sequence[str], top: int) -> DataFrame:
    """``(id, rank, feature, value, deviation, explanation)``: the features furthest from their mean, in deviations.

    One aggregate; the ``top`` are picked within the row. Ties go to the feature named first.
    """
    fit = df.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    deviation = [F.coalesce(F.try_divide(F.col(c) - F.col(f"__m{i}"), F.col(f"__s{i}")), F.lit(0.0)) for i, c in enumerate(columns)]
    items = F.array(*[F.struct((-F.abs(z)).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), z.alias("deviation")) for i, (c, z) in enumerate(zip(columns, deviation))])
    picked = df.crossJoin(F.broadcast(fit)).select(F.col(id_col), F.posexplode(F.slice(F.array_sort(items), 1, top)).alias("p", "e"))
    side = F.when(F.col("e.deviation") >= 0, "above").otherwise("below")
    return picked.select(id_col, (F.col("p") + 1).alias("rank"), F.lit("transaction").alias("type"), "e.feature", "e.value", "e.deviation", F.concat(F.col("e.feature"), F.lit(" is "), side, F.lit(" its mean")).alias("explanation"))


@F.udtf(returnType="feature string, value double, deviation double")
class EvidenceRows:
    """One row for each feature that lies ``least`` deviations or more from its mean; features without a deviation have none."""

    def eval(self, names: list, values: list, means: list, deviations: list, least: float):
        for name, x, m, s in zip(names, values, means, deviations):
            if x is not None and s and abs(x - m) / s >= least:
                yield name, x, (x - m) / s


def expanded(df: DataFrame, id_col: str, columns: Sequence[str], least: float) -> DataFrame:
    """``(id, feature, value, deviation)`` of all features at least so far from their mean, by a table function on each row."""
    spark = df.sparkSession
    fit = df.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("__m"), F.array(*[F.stddev_samp(F.col(c).cast("double")) for c in columns]).alias("__s"))
    spark.udtf.register("normcast_evidence_rows", EvidenceRows)
    rows = df.crossJoin(F.broadcast(fit)).select(id_col, F.array(*[F.lit(c) for c in columns]).alias("__n"), F.array(*[F.col(c).cast("double") for c in columns]).alias("__v"), "__m", "__s")
    return spark.sql(f"SELECT r.`{id_col}`, e.* FROM {{rows}} r, LATERAL normcast_evidence_rows(r.__n, r.__v, r.__m, r.__s, {float(least)!r}D) e", rows=rows)


def log_experiment(spark: SparkSession, path: str, **fields: object) -> None:
    """Append one row to the experiment log: a Parquet table with a column for each of ``EXPERIMENT``; fields that are no strings are kept as JSON."""
    if unknown := set(fields) - set(EXPERIMENT):
        raise ContractError(f"the log has no such fields: {', '.join(sorted(unknown))}")
    if not fields.get("id"):
        raise ContractError("an experiment needs an id")
    row = tuple(v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True) for v in (fields.get(n) for n in EXPERIMENT))
    spark.createDataFrame([row], ", ".join(f"{n} string" for n in EXPERIMENT)).write.mode("append").parquet(path)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{n} string" for n in EXPERIMENT)).parquet(path)


def cases(df: DataFrame, account: str, score: str, level: str, levels: Sequence[str]) -> DataFrame:
    """One case for each account with a row of one of the levels: its number of rows and its highest score."""
    return df.filter(F.col(level).isin(*levels)).groupBy(account).agg(F.count("*").alias("n"), F.max(score).alias("priority"))


def case_members(df: DataFrame, account: str, id_col: str, level: str, levels: Sequence[str]) -> DataFrame:
    """``(account, id)`` of every row of a case, whose key is the account: nothing is gathered, so a case may have any number of rows."""
    return df.filter(F.col(level).isin(*levels)).select(account, F.col(id_col).alias("id"))


def routed(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """Scores between the limits (both included) go to the second model, the rest stay with the first."""
    return df.withColumn("route", F.when(F.col(score).between(low, high), "second").otherwise("first"))


def combined(classical: DataFrame, other: DataFrame, id_col: str, score: str, rule: Column | None = None) -> DataFrame:
    """Each row's score by the other model where there is one, else by the classical: ``score`` and ``method``.

    ``rule`` may combine ``classical_score`` and ``other_score`` where both exist.
    """
    j = classical.select(id_col, F.col(score).alias("classical_score")).join(other.select(id_col, F.col(score).alias("other_score")), id_col, "left")
    both = F.col("other_score").isNotNull()
    return j.select(id_col, F.when(both, rule if rule is not None else F.col("other_score")).otherwise(F.col("classical_score")).alias("score"), F.when(both, "combined" if rule is not None else "other").otherwise("classical").alias("method"))


def traced(df: DataFrame, **names: str) -> DataFrame:
    """Constant columns that say how a row came about: model, versions, configuration."""
    return df.withColumns({k: F.lit(v) for k, v in names.items()})


def distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
