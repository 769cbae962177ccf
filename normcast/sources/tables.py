"""Scans, sinks, settings and generators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The texts that the usual CSV readers take for a missing value.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def transaction_schema(features: int = 28) -> T.StructType:
    return T.StructType([T.StructField("Time", T.DoubleType()), *[T.StructField(f"V{i}", T.DoubleType()) for i in range(1, features + 1)], T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_csv(spark: SparkSession, path: str | Path, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header. Columns are read as text, usual missing texts become null, then types are
    tried: those of ``schema`` by name, else what the file's values suggest. A missing file raises ``FileNotFoundError``."""
    path = str(path)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).csv(path)
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    kinds = {f.name: f.dataType.simpleString() for f in schema} if schema else _suggested(clean)
    return clean.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, "string")).alias(c) for c in clean.columns])


def _suggested(df: DataFrame) -> dict[str, str]:
    """bigint where every value is one, else double, else string: one pass."""
    tests = [F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(k).isNotNull()).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in ("bigint", "double")]
    row = df.agg(*tests).first()
    return {c: "bigint" if row[f"bigint{i}"] and row[f"bigint{i}"] is not None else "double" if row[f"double{i}"] else "string" for i, c in enumerate(df.columns)}


def write_csv(df: DataFrame, path: str, replace: bool = False) -> None:
    """With a header and no index; an existing target is left alone unless it is to be replaced."""
    df.write.mode("overwrite" if replace else "ignore").option("header", True).csv(path)


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Zones of a table's life, in order.
ZONES = ("raw", "processed", "features", "predictions")


def write_zone(df: DataFrame, root: str, zone: str, name: str, version: str) -> str:
    """Parquet under zone, name and version; versions are partitions, so older ones stay."""
    if zone not in ZONES:
        raise ValueError(f"zone must be one of {ZONES}")
    path = f"{root}/{zone}/{name}"
    df.withColumn("feature_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_version").parquet(path)
    return path


@dataclass(frozen=True)
class DataSettings:
    raw_path: str = ""


@dataclass(frozen=True)
class SplitSettings:
    train_ratio: float = 0.70
    validation_ratio: float = 0.15
    test_ratio: float = 0.15
    random_seed: int = 42
    feature_columns: tuple[str, ...] = ()
    target_column: str = "Class"


@dataclass(frozen=True)
class Settings:
    data: DataSettings = field(default_factory=DataSettings)
    preprocessing: SplitSettings = field(default_factory=SplitSettings)

    @classmethod
    def from_mapping(cls, given: dict | None) -> "Settings":
        """Blank sections take their defaults; unknown keys raise ``TypeError``; ratios must sum to 1."""
        given = given or {}
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise TypeError(f"unknown sections: {sorted(unknown)}")
        pre = dict(given.get("preprocessing") or {})
        if "feature_columns" in pre:
            pre["feature_columns"] = tuple(pre["feature_columns"] or ())
        out = cls(DataSettings(**(given.get("data") or {})), SplitSettings(**pre))
        p = out.preprocessing
        if abs(p.train_ratio + p.validation_ratio + p.test_ratio - 1) > 1e-9:
            raise ValueError("ratios must sum to 1")
        return out

    @classmethod
    def from_yaml(cls, path: str | Path) -> "Settings":
        import yaml

        return cls.from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def synthetic_transactions(spark: SparkSession, n: int, features: int = 28, seed: int = 42) -> DataFrame:
    """Time 0..n-1, normal features, even amounts up to 2,000 and labels of either kind."""
    df = spark.range(n).select(F.col("id").alias("Time"), *[F.randn(seed + i).alias(f"V{i}") for i in range(1, features + 1)], (F.rand(seed) * 2000).alias("Amount"), (F.rand(seed + 99) < 0.5).cast("int").alias("Class"))
    return df


def two_moons(spark: SparkSession, n: int = 100, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Two half circles that reach into each other: ``(id, x, y, label)``."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, np.pi, n // 2)
    xy = np.concatenate([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]]) + rng.normal(0, noise, (2 * (n // 2), 2))
    return spark.createDataFrame([(i, float(x), float(y), int(i >= n // 2)) for i, (x, y) in enumerate(xy)], "id long, x double, y double, label int")


def digit_images(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Noisy 8 x 4 images of a ring (0) or a bar (1), strokes 0.9 to 1 on a ground of 0 to 0.1, rows of unit length: ``(id, pixels, label)``."""
    rng = np.random.default_rng(seed)
    ring, bar = np.zeros((8, 4)), np.zeros((8, 4))
    ring[[1, -2], 1:3], ring[2:-2, [0, -1]], bar[1:-1, 1:3] = 1, 1, 1
    rows = []
    for i in range(n):
        label = int(rng.integers(2))
        stroke = (bar if label else ring) > 0
        x = np.where(stroke, rng.uniform(0.9, 1.0, (8, 4)), rng.uniform(0.0, 0.1, (8, 4))).ravel()
        rows.append((i, (x / np.linalg.norm(x)).tolist(), label))
    return spark.createDataFrame(rows, "id long, pixels array<double>, label int")


def peek(df: DataFrame, n: int = 5) -> dict:
    """A few rows, the number of columns and their types; no count, which would read all."""
    return {"rows": df.limit(n).collect(), "n_columns": len(df.columns), "types": dict(df.dtypes)}


def column_slice(df: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def vector_columns(df: DataFrame, vector: str, size: int, prefix: str = "V") -> DataFrame:
    """The first ``size`` components as columns prefix1, prefix2, ..."""
    return df.select("*", *[F.col(vector)[i].cast("double").alias(f"{prefix}{i + 1}") for i in range(size)])


def columns_vector(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))
