"""Splits and samples that rerun alike: by exact time rank or by a hash of the id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normcast.functions.scalar import salted_rank_key
from normcast.operators.ordered import among_each, among_first, order_keys
from normcast.operators.quality import ContractError, require_columns

TRAIN, VALIDATION, TEST = "train", "validation", "test"


@dataclass(frozen=True)
class Split:
    """One lazy table with a ``split`` column, its feature columns and metadata."""

    rows: DataFrame
    feature_columns: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name).drop("split")

    @property
    def train(self) -> DataFrame:
        return self.part(TRAIN)

    @property
    def validation(self) -> DataFrame:
        return self.part(VALIDATION)

    @property
    def test(self) -> DataFrame:
        return self.part(TEST)


def cut_points(n: int, train: float, validation: float) -> tuple[int, int]:
    """Rows before the two cuts: double products, truncated."""
    if train < 0 or validation < 0 or 1 - (train + validation) < 1e-9:
        raise ContractError(f"nothing is left for the test split: {train} + {validation}")
    return int(n * train), int(n * (train + validation))


def _keyed(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with numeric columns in whose order it is read: those of the named columns, missing values last, then a hash of the whole row, then its place."""
    plain = [F.col(f"`{n}`") for n, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    keys = [k for n in names for k in order_keys(df, n)] + [F.xxhash64(*plain), F.monotonically_increasing_id()]
    own = [f"__k{i}" for i in range(len(keys))]
    return df.withColumns(dict(zip(own, keys))), own


def temporal_split(df: DataFrame, time_col: str, id_col: str, train: float = 0.70, validation: float = 0.15) -> Split:
    """Earliest rows train, the next validate, the latest test: exact counts at every size of table.

    Ties in time are broken by id, rows of one time and id by a hash of all their columns; rows alike in all columns, which
    are the same on either side of a cut, by their place in the input. Missing times come last, and missing ids last of their time. The two cut keys are
    found from histograms and every row is compared with them where it lies: no sort and no shuffle of rows.
    """
    cut_points(1, train, validation)
    require_columns(df, [time_col, id_col])
    keyed, own = _keyed(df, time_col, id_col)
    slim = keyed.select(*own)
    n = df.count()
    a, b = cut_points(n, train, validation)
    first, second = among_each(slim, own, [a, b])
    rows = keyed.withColumn("split", F.when(first, TRAIN).when(second, VALIDATION).otherwise(TEST)).drop(*own)
    meta = {"train_ratio": train, "validation_ratio": validation, "test_ratio": round(1 - train - validation, 6), "n_train": a, "n_validation": b - a, "n_test": n - b}
    return Split(rows, (), meta)


def hash_split(df: DataFrame, id_col: str, test: float, seed: int = 42) -> DataFrame:
    """``split`` by a threshold on the id's hash: no shuffle, sizes near the share, an id always on one side."""
    place = F.conv(F.substring(salted_rank_key(F.col(id_col), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(place < int(test * (1 << 32)), TEST).otherwise(TRAIN))


def undersample(df: DataFrame, label: Column, keep: int, id_col: str, seed: int = 42) -> DataFrame:
    """All positives, and the ``keep`` negatives that come first in hash order."""
    key = salted_rank_key(F.col(id_col), seed)
    return df.filter(label == 1).unionByName(df.filter(label == 0).orderBy(key, id_col).limit(keep))


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(salted_rank_key(F.col(id_col), seed), id_col)


def normal_rows(df: DataFrame, label: Column) -> DataFrame:
    return df.filter(label == 0)


def held_out_normals_with_anomalies(df: DataFrame, label: Column, time_col: str, id_col: str, first: int) -> tuple[DataFrame, DataFrame]:
    """Train: the first normal rows by time, then id; test: the later normal rows and all anomalies. No row is in both."""
    keyed, own = _keyed(df, time_col, id_col)
    normals = normal_rows(keyed, label)
    slim = normals.select(*own)
    early = among_first(slim, own, min(first, slim.count()))
    return normals.filter(early).drop(*own), normals.filter(~early).drop(*own).unionByName(df.filter(label == 1))


def row_range(df: DataFrame, time_col: str, id_col: str, first: int, last: int) -> DataFrame:
    """The rows from place ``first`` to place ``last`` (from 0, both included) in the order of ``temporal_split``."""
    keyed, own = _keyed(df, time_col, id_col)
    slim = keyed.select(*own)
    n = slim.count()
    before, upto = among_each(slim, own, [min(max(k, 0), n) for k in (first, last + 1)])
    return keyed.filter(upto & ~before).drop(*own)


def rows_at(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows with the keys of ``wanted``: one join, never a lookup for each."""
    return df.join(wanted.select(key), key, "left_semi")


def overlap(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Ids on both sides."""
    return a.select(id_col).join(b.select(id_col), id_col, "left_semi").distinct()


def bounds(rows: DataFrame, time_col: str) -> DataFrame:
    """By split: rows and their first and last time."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))
