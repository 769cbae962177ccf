"""Transforms that are fitted by an aggregate, on chosen rows, and applied to all."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normcast.functions.scalar import coded, dot, equal_width_bin, flag, replaced, right_closed_bin, signed_log
from normcast.operators.detectors import vector_moments
from normcast.operators.ordered import percentiles
from normcast.operators.profiling import corrected_skewness
from normcast.operators.quality import ContractError
from normcast.operators.splitting import TRAIN, Split


def _only(where: Column | None, x: Column) -> Column:
    return x if where is None else F.when(where, x)


def _with_fit(df: DataFrame, *fitted: Column) -> DataFrame:
    """Every row with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(df.agg(*fitted)))


def feature_columns(columns: Sequence[str], prefix: str = "V", amount: str = "Amount") -> list[str]:
    """Names of the prefix and a number, in order of the number, then the amount. Other names are no features."""
    numbered = sorted((int(m[1]), c) for c in columns if (m := re.fullmatch(rf"{prefix}(\d+)", c)))
    return [c for _, c in numbered] + [amount] * (amount in columns)


def standard_scale(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0), fitted on ``where``."""
    stats = [f(_only(where, F.col(c))).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = _with_fit(df, *stats)
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def minmax_scale(df: DataFrame, columns: Sequence[str], where: Column | None = None, keep_fit: bool = False) -> DataFrame:
    """Columns to 0..1 by the range on ``where``; a constant column becomes 0. ``keep_fit`` leaves ``lo_c`` and ``hi_c``."""
    out = _with_fit(df, *[f(_only(where, F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    out = out.withColumns(scaled)
    return out if keep_fit else out.select(*df.columns)


def minmax_inverse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undo ``minmax_scale(keep_fit=True)``."""
    return df.withColumns({c: F.col(c) * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) + F.col(f"lo_{c}") for c in columns})


def tame_skew(df: DataFrame, columns: Sequence[str], over: float = 0.75) -> DataFrame:
    """Signed logarithm of the columns whose absolute skewness is over the limit."""
    out = _with_fit(df, *[corrected_skewness(F.col(c)).alias(f"__k_{c}") for c in columns])
    return out.withColumns({c: F.when(F.abs(f"__k_{c}") > over, signed_log(F.col(c))).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def impute_median(df: DataFrame, column: str) -> DataFrame:
    (middle,) = percentiles(df, column, [0.5])
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(middle)))


def impute_random(df: DataFrame, column: str, seed: int) -> DataFrame:
    """Missing values become whole numbers drawn evenly between mean - deviation and mean + deviation."""
    out = _with_fit(df, F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    drawn = F.floor(F.col("__m") - F.col("__s") + F.rand(seed) * 2 * F.col("__s"))
    return out.withColumn(column, F.coalesce(F.col(column), drawn)).drop("__m", "__s")


def quantile_bins(df: DataFrame, column: str, out: str, n: int = 4) -> DataFrame:
    """Right-closed bins between exact quantiles."""
    cuts = percentiles(df, column, [i / n for i in range(1, n)])
    return df.withColumn(out, reduce(lambda a, q: a + (F.col(column) > F.lit(q)).cast("int"), cuts, F.lit(0)))


def equal_width_bins(df: DataFrame, column: str, out: str, n: int = 5) -> DataFrame:
    fitted = _with_fit(df, F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return fitted.withColumn(out, equal_width_bin(F.col(column), F.col("__lo"), F.col("__hi"), n)).drop("__lo", "__hi")


def fixed_bins(df: DataFrame, column: str, out: str, edges: Sequence[float]) -> DataFrame:
    return df.withColumn(out, right_closed_bin(F.col(column), edges))


def build_features(split: Split, columns: Sequence[str] | None = None, target: str = "Class", amount: str = "Amount", keep: Sequence[str] = ()) -> Split:
    """Features in order, the amount scaled by training rows alone, the target last if it is there.

    No list, or an empty one, detects the features. ``keep`` passes ids and times along in front.
    """
    columns = list(columns or feature_columns(split.rows.columns, amount=amount))
    if lacking := [c for c in columns if c not in split.rows.columns]:
        raise ContractError(f"features are not in the table: {', '.join(lacking)}")
    rows, scaled = split.rows, [amount] * (amount in columns)
    if scaled:
        rows = standard_scale(rows, scaled, F.col("split") == TRAIN)
    wanted = [*keep, *columns, *[target] * (target in rows.columns), "split"]
    meta = {"feature_columns": columns, "target_column": target, "scaled_columns": scaled, "scaler": "standard" if scaled else None}
    return Split(rows.select(*dict.fromkeys(wanted)), tuple(columns), split.metadata | meta)


def pca(df: DataFrame, columns: Sequence[str], k: int, prefix: str = "pc") -> tuple[DataFrame, np.ndarray]:
    """Scores on the first ``k`` principal components of standardised columns, and each component's share of variance.

    One aggregate gives the d x d correlations; the sign of a component makes its largest loading positive.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = stats[f"c{i}_{j}"] or 0.0
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-values)[:k]
    load = vectors[:, order]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), range(len(order))])
    z = [(F.col(c) - F.lit(float(stats[f"m{i}"] or 0.0))) / F.lit(float(sd[i])) for i, c in enumerate(columns)]
    scores = {f"{prefix}{n + 1}": reduce(lambda a, b: a + b, [z[i] * F.lit(float(load[i, n])) for i in range(d)]) for n in range(len(order))}
    return df.withColumns(scores), values[order] / max(values.sum(), 1e-300)


def vector_pca(df: DataFrame, vector: str, k: int, prefix: str = "pc") -> tuple[DataFrame, np.ndarray]:
    """``pca`` of a vector column's standardised components, all of them: the moments are summed by place, the scores are expressions."""
    _, mean, cov = vector_moments(df, vector)
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-values)[:k]
    load = vectors[:, order]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), range(len(order))])
    weights = load / sd[:, None]
    scores = {f"{prefix}{n + 1}": dot(F.col(vector), F.array(*[F.lit(float(w)) for w in weights[:, n]])) - F.lit(float(mean @ weights[:, n])) for n in range(len(order))}
    return df.withColumns(scores), values[order] / max(values.sum(), 1e-300)


#: Fixed values of the passenger features: titles that count as one, codes, and right-closed edges.
TITLE_GROUPS = {"Rare": ("Lady", "Countess", "Capt", "Col", "Don", "Dr", "Major", "Rev", "Sir", "Jonkheer", "Dona"), "Miss": ("Mlle", "Ms"), "Mrs": ("Mme",)}
TITLE_CODES = {"Mr": 1, "Miss": 2, "Mrs": 3, "Master": 4, "Rare": 5}
SEX_CODES = {"female": 0, "male": 1}
PORT_CODES = {"S": 0, "C": 1, "Q": 2}
FARE_EDGES = (7.91, 14.454, 31)
AGE_EDGES = (16, 32, 48, 64)


def passenger_features(rows: DataFrame, train: DataFrame, seed: int = 42) -> DataFrame:
    """Numeric features of a passenger list (columns ``Name Sex Age SibSp Parch Fare Cabin Embarked``), fitted on ``train``.

    Length of the name, whether a cabin is known, size of the family and whether the passenger is alone, codes of title, sex and port
    (unknown port: S; unknown title or sex: 0), fare in bins (missing: the median fare of ``train``) and age in bins (missing: drawn as by
    ``impute_random`` from the rows' own mean and deviation). Identifying columns are dropped, others stay.
    """
    (fare,) = percentiles(train, "Fare", [0.5])
    family = F.coalesce("SibSp", F.lit(0)) + F.coalesce("Parch", F.lit(0)) + 1
    title = replaced(F.regexp_extract(F.coalesce("Name", F.lit("")), r" ([A-Za-z]+)\.", 1), TITLE_GROUPS)
    out = impute_random(rows, "Age", seed).withColumns({
        "Name_length": F.length("Name"),
        "Has_Cabin": flag(F.col("Cabin").isNotNull()),
        "FamilySize": family,
        "IsAlone": flag(family == 1),
        "Title": coded(title, TITLE_CODES),
        "Sex": coded(F.col("Sex"), SEX_CODES),
        "Embarked": coded(F.coalesce("Embarked", F.lit("S")), PORT_CODES),
        "Fare": right_closed_bin(F.coalesce("Fare", F.lit(fare)), FARE_EDGES),
        "Age": right_closed_bin(F.col("Age").cast("int"), AGE_EDGES),
    })
    return out.drop("PassengerId", "Name", "Ticket", "Cabin", "SibSp")
