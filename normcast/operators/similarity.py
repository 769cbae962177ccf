"""Pairs of vectors: nearest neighbours, kernels, local density. Blocks of vectors meet blocks, never row by row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cosine_top(queries: DataFrame, corpus: DataFrame, id_col: str, vector: str, k: int, size: int = 1024) -> DataFrame:
    """``(query_id, rank, id, similarity)`` of every query's ``k`` most similar other rows, ties to the smaller id.

    Blocks of queries meet blocks of the corpus and each meeting keeps its k best, so neither side is broadcast. A zero vector's similarity is
    null and comes last. Filter the corpus first.
    """

    def best(iq, ic, q, c):
        with np.errstate(invalid="ignore", divide="ignore"):
            s = q @ c.T / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None])
        s[~np.isfinite(s)] = -2.0
        s[iq[:, None] == ic[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(ic, s.shape), -s), axis=1)[:, :k]
        top = np.take_along_axis(s, order, 1)
        row, col = np.nonzero(top > -np.inf)
        found = top[row, col]
        yield pa.RecordBatch.from_arrays([pa.array(iq[row]), pa.array(ic[order[row, col]]), pa.array(found, mask=found < -1.5)], ["query_id", "id", "similarity"])

    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "id")
    return _met(queries, id_col, vector, best, "query_id long, id long, similarity double", size, others=corpus).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def packed_blocks(rows: DataFrame, id_col: str, vector: str, size: int = 1024) -> DataFrame:
    """``(block, ids, vectors, n)``: doubles of about ``size`` rows each, dealt by a hash of id and vector.

    Its partitions are so many that pairs of them keep all machines busy, and hold some 64 blocks at most.
    """
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    parts = min(blocks, max(math.ceil((16 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5), -(-blocks // 48)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        width = len(lists[0]) if lists[0].is_valid else 0
        if pc.all(pc.equal(pc.fill_null(pc.list_value_length(lists), -1), width)).as_py():
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)
        else:
            v = np.array(lists.to_pylist(), float)
        return pa.table({"block": [key[0].as_py()], "ids": [table.column("id").to_numpy().astype("<i8").tobytes()], "vectors": [v.tobytes()], "n": [len(v)]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int64())]))

    return dealt.repartition(parts, "block").groupBy("block").applyInArrow(pack, "block long, ids binary, vectors binary, n long")


def _met(rows: DataFrame, id_col: str, vector: str, per_pair: Callable, schema: str, size: int, upper: bool = False, others: DataFrame | None = None) -> DataFrame:
    blocks = packed_blocks(rows, id_col, vector, size)
    sides = (blocks, blocks if others is None else packed_blocks(others, id_col, vector, size))
    a, b = (x.select(*[F.col(c).alias(f"{s}_{c}") for c in x.columns]) for s, x in zip("ab", sides))
    # each partition of one side reads each of the other: no pair of blocks is shuffled, and neither side broadcast
    meet = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_block") <= F.col("b_block")) if upper else F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                ids = [np.frombuffer(x[f"{s}_ids"], "<i8") for s in "ab"]
                vs = [np.frombuffer(x[f"{s}_vectors"], float).reshape(x[f"{s}_n"], -1) for s in "ab"]
                yield from per_pair(*ids, *vs)

    return meet.mapInArrow(run, schema)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences are squared directly, so equal vectors are at distance 0."""
    out = np.empty((len(x), len(y)))
    for i in range(len(x)):
        d = y - x[i]
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def nearest(rows: DataFrame, id_col: str, vector: str, k: int, size: int = 1024) -> DataFrame:
    """``(id, other, distance, rank)``: the ``k`` nearest other rows, ties to the smaller id. Each pair of blocks keeps its k best."""

    def best(ia, ib, va, vb):
        d = _distances(va, vb)
        d[ia[:, None] == ib[None]] = np.inf
        order = np.lexsort((np.broadcast_to(ib, d.shape), d), axis=1)[:, :k]
        near = np.take_along_axis(d, order, 1)
        row, col = np.nonzero(np.isfinite(near))
        yield pa.RecordBatch.from_arrays([pa.array(ia[row]), pa.array(ib[order[row, col]]), pa.array(near[row, col])], ["id", "other", "distance"])

    w = Window.partitionBy("id").orderBy("distance", "other")
    return _met(rows, id_col, vector, best, "id long, other long, distance double", size).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within(rows: DataFrame, id_col: str, vector: str, radius: float, size: int = 1024) -> DataFrame:
    """``(id, other)``: all other rows within the radius."""

    def close(ia, ib, va, vb):
        row, col = np.nonzero(_distances(va, vb) <= radius)
        keep = ia[row] != ib[col]
        yield pa.RecordBatch.from_arrays([pa.array(ia[row[keep]]), pa.array(ib[col[keep]])], ["id", "other"])

    return _met(rows, id_col, vector, close, "id long, other long", size)


#: Settings of the Parquet writer, and their least: bytes of a column's dictionary and of a page, rows of a page. Values rounded to six decimals
#: repeat, but are more than Spark's 1 MB of dictionary holds, and too rarely twice within 20,000 rows for it to be kept.
PAGES = {"parquet.dictionary.page.size": 8 << 20, "parquet.page.size": 8 << 20, "parquet.page.row.count.limit": 1 << 20}


def wide_dictionaries(spark: SparkSession) -> None:
    """Raise the session's Parquet settings to ``PAGES``; larger ones stay.

    They change no result, and stay when an operator has returned, as its result is written when its caller runs it.
    """
    for name, least in PAGES.items():
        if int(spark.conf.get(name, None) or 0) < least:
            spark.conf.set(name, least)


def _rounded_kernel(x: np.ndarray, y: np.ndarray, gamma: float, decimals: int) -> np.ndarray:
    """exp(-gamma |x - y|^2), halves rounded up, of all pairs.

    One matrix product gives the distances, each with a bound of its error; values that may round otherwise within their bound are found again from
    the differences, their squares added in order.
    """
    unit, eps = 10.0**decimals, np.finfo(float).eps
    with np.errstate(invalid="ignore", over="ignore"):
        norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
        k = np.exp(-gamma * np.maximum(norms - 2 * (x @ y.T), 0))
        off = abs(gamma) * (2 * x.shape[1] + 8) * eps * norms
        scaled = k * unit
        bound = np.where(off < 1e-3, scaled * (1.01 * off + 8 * eps), np.inf)
        row, col = np.nonzero(~(np.abs(scaled - np.floor(scaled) - 0.5) > bound))
        for at in range(0, len(row), 4096):
            r, c = row[at : at + 4096], col[at : at + 4096]
            d = np.sqrt(np.cumsum((x[r] - y[c]) ** 2, axis=1)[:, -1])
            scaled[r, c] = np.array([math.exp(v) for v in (-gamma * d**2).tolist()]) * unit
        whole = np.floor(scaled)
        return (whole + (scaled - whole >= 0.5)) / unit


def rbf_gram(rows: DataFrame, id_col: str, vector: str, gamma: float, size: int = 512, decimals: int | None = None) -> DataFrame:
    """``(i, j, k)`` with i <= j of the kernel exp(-gamma |x - y|^2); the rest follows by symmetry.

    ``decimals`` rounds k, halves up. The result has n (n + 1) / 2 rows, in runs of i with ascending j; rounded ones are written to Parquet as
    indices of a dictionary.
    """
    if decimals is not None:
        wide_dictionaries(rows.sparkSession)

    def kernel(ia, ib, va, vb):
        a, b = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
        ia, ib, va, vb = ia[a], ib[b], va[a], vb[b]
        # both sides of a block are packed apart, in the order in which machines sent its rows
        same = len(ia) == len(ib) and (ia == ib).all()
        k = np.exp(-gamma * _distances(va, vb) ** 2) if decimals is None else _rounded_kernel(va, vb, gamma, decimals)
        keep = ia[:, None] <= ib[None]
        for lo, hi, value, kept in ((ia, ib, k, keep), *[(ib, ia, k.T, ~keep.T)] * (not same)):
            r, c = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays([pa.array(lo[r]), pa.array(hi[c]), pa.array(value[kept])], ["i", "j", "k"])

    return _met(rows, id_col, vector, kernel, "i long, j long, k double", size, upper=True)


def local_outlier_factor(rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """``(id, lof)`` from exactly ``k`` neighbours (Breunig et al. 2000)."""
    near = nearest(rows, id_col, vector, k).select("id", "other", "distance")
    reach_of = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reach = near.join(reach_of.select(F.col("id").alias("other"), "k_distance"), "other").withColumn("reach", F.greatest("distance", "k_distance"))
    density = reach.groupBy("id").agg((F.count("*") / F.greatest(F.sum("reach"), F.lit(1e-300))).alias("lrd"))
    others = near.join(density.select(F.col("id").alias("other"), F.col("lrd").alias("other_lrd")), "other")
    return others.groupBy("id").agg(F.avg("other_lrd").alias("m")).join(density, "id").select("id", (F.col("m") / F.col("lrd")).alias("lof"))


def density_noise(rows: DataFrame, id_col: str, vector: str, radius: float, least: int) -> DataFrame:
    """``(id, n_near, is_core, is_noise)``: a core row has ``least`` rows within the radius, itself counted; noise is no core row and near none."""
    links = within(rows, id_col, vector, radius)
    counts = rows.select(F.col(id_col).cast("long").alias("id")).join(links.groupBy("id").agg(F.count("*").alias("m")), "id", "left").select("id", (F.coalesce("m", F.lit(0)) + 1).alias("n_near"))
    core = counts.filter(F.col("n_near") >= least).select(F.col("id").alias("other"))
    touched = links.join(core, "other", "left_semi").select("id").distinct().withColumn("__t", F.lit(1))
    is_core = F.col("n_near") >= least
    return counts.join(touched, "id", "left").select("id", "n_near", is_core.cast("int").alias("is_core"), (~is_core & F.col("__t").isNull()).cast("int").alias("is_noise"))
