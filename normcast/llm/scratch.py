"""Written intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder if all tasks run on this machine, as in tests, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="normcast-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/normcast/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, computed once and read back from a table: short lineage, stable on recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later result reads."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Settings that bound what a task holds of long texts at once, and their most: rows and bytes of a batch between Spark and
#: Python, and rows of a batch of the Parquet reader.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
}


def small_batches(spark: SparkSession) -> None:
    """Hold the session's batches to ``BATCHES``; smaller settings stay.

    They change no result. They also stay when an operator has returned, as its result is planned when its caller runs it.
    """
    for name, most in BATCHES.items():
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= most:
            spark.conf.set(name, most)


def tidied(batches: Iterator[T]) -> Iterator[T]:
    """The batches of a task in a Python worker, which gives free memory back to the machine now and then and at the end."""
    for i, b in enumerate(batches, 1):
        yield b
        if i % 16 == 0:
            _give_back()
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        pass


def hash_sample(ids: DataFrame, most: int) -> DataFrame:
    """Of distinct ids (one column) all, or the ``most`` with the smallest hash.

    A count sets a hash limit that about twice as many pass, so the sort sees few rows however many
    partitions there are. In the unheard-of case that under ``most`` pass, these are the sample.
    """
    name, n = ids.columns[0], ids.count()
    h = F.pmod(F.xxhash64(name), F.lit(1 << 32))
    if n > 2 * most:
        ids = ids.filter(h < (1 << 33) * most // n)
    return ids.orderBy(h, name).limit(most)


#: Keys with more rows than this, and than their ten-thousandth part of all rows, are hot.
_HOT_ROWS = 32


def hot_above(n_rows: int) -> int:
    """The number of rows over which a key is hot: fewer than 10,000 keys can be."""
    return max(_HOT_ROWS, n_rows // 10_000)


def joined(rows: DataFrame, one: DataFrame, keys: list[str], n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``keys`` with ``one``, which has a row for each key and in ``n`` the key's number of rows.

    The hot keys' rows of ``one``, fewer than 10,000, are broadcast, so the rows of a hot key stay where they lie; only the others are
    shuffled. ``n`` is dropped. Keys are not null.
    """
    hot, cold = one.filter(F.col("n") > hot_above(n_rows)).drop("n"), one.filter(F.col("n") <= hot_above(n_rows)).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
