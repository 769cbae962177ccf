"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length and cut into buckets of similar length. For a query with threshold
t (its k-th best product so far) a bucket whose longest vector has length l needs a cosine of at
least t / (|q| l): over 1, the bucket is skipped; high, candidates are pruned by the intervals that
the query's largest coordinates allow; else only by length. What is left is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normcast.llm.scratch import shuffle_width, written

#: Slack of float comparisons; pruning is never tighter than exact arithmetic.
_SLACK = 1e-9
#: The largest score that a double and a long both hold.
_MOST = float(2**63 - 1024)
_CANDIDATES = "part int, dim int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def packed(ids: np.ndarray, vectors: np.ndarray) -> dict:
    return {"dim": vectors.shape[1], "ids": ids.astype("<i8").tobytes(), "vectors": vectors.astype("<f8").tobytes()}


def unpacked(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)


#: The id of no candidate.
_NONE = np.iinfo(np.int64).max


class Best:
    """The k best ids of each query of one block, each with its highest score: larger score first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), _NONE)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """New scores of some queries (-inf: none) against the candidates ``ids``, in which an id may occur more than once."""
        scores, ids = by_id(scores, ids)
        if scores.shape[1] > 4 * self.k:
            # what lies below the k-th largest of as many ids can't enter; ties with it are kept for their ids
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            alive = np.maximum(kth, self.scores[rows, -1])
            hit = (scores >= alive[:, None]).any(axis=0)
            scores, ids = scores[:, hit], ids[hit]
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.where(scores > -np.inf, ids, _NONE)], axis=1)
        if np.isin(ids, self.ids[rows]).any():
            order = np.lexsort((-s, i), axis=1)
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            again = np.zeros(s.shape, bool)
            again[:, 1:] = i[:, 1:] == i[:, :-1]
            s[again], i[again] = -np.inf, _NONE
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def by_id(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns with the same id one, with the highest scores."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0])) if len(ids) else order
    if len(first) == len(ids):
        return scores, ids
    return np.maximum.reduceat(scores[:, order], first, axis=1), ids[order][first]


def search_bucket(best: Best, q_ids: np.ndarray, q: np.ndarray, q_len: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_len: np.ndarray, high: float, focus: int) -> None:
    """Search one bucket (longest first). ``floor``: scores below it can't be among a query's k best."""
    t = np.maximum(best.scores[:, -1], floor)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_len * c_len[0] > 0, t / (q_len * c_len[0]), -np.inf)
    possible = ~((q_len * c_len[0] * (1 + _SLACK) + _SLACK) < t)
    by_coordinate = possible & (cosine >= high)
    by_length = np.flatnonzero(possible & ~by_coordinate)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(q_len[by_length] > 0, t[by_length] / q_len[by_length], -np.inf)
        n = int(np.searchsorted(-c_len, -(least.min() * (1 - _SLACK) - _SLACK), "right"))
        if n:
            scores = q[by_length] @ c[:n].T
            scores[q_ids[by_length][:, None] == c_ids[None, :n]] = -np.inf
            best.merge(by_length, scores, c_ids[:n])
    unit = None
    for k in np.flatnonzero(by_coordinate):
        if unit is None:
            unit = c / np.maximum(c_len, 1e-300)[:, None]
        x, need = q[k] / q_len[k], min(1.0, cosine[k])
        alive = np.ones(len(c), bool)
        for d in np.argsort(-np.abs(x))[:focus]:
            spread = np.sqrt(max(0.0, 1 - x[d] ** 2) * max(0.0, 1 - need**2)) + 1e-7
            if x[d] * need + spread < 1:
                alive &= unit[:, d] <= x[d] * need + spread if x[d] <= 0 or need >= x[d] else True
            if x[d] * need - spread > -1:
                alive &= unit[:, d] >= x[d] * need - spread if x[d] >= 0 or need >= -x[d] else True
        alive &= q_ids[k] != c_ids
        if alive.any():
            best.merge(np.array([k]), (c[alive] @ q[k])[None, :], c_ids[alive])


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v, norm2)`` with v = floor(scale * x), whole numbers as doubles; without ids, or with null or non-finite components, none."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    out = rows.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))


def top_k(rows: DataFrame, is_query: F.Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 16_384, bucket: int = 1_024, high: float = 0.8, focus: int = 4) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` ids with the largest integer products of each query, ties to the smaller id.

    Queries are the rows where ``is_query`` holds; candidates all rows but those with the query's own
    id. Vectors of other lengths than the query's have no product with it. Null vectors, vectors
    with null or non-finite components, and null ids take no part. Exactly repeated rows count once;
    rows of one id with different vectors count by the highest score of any of them, and their queries share one ranking.
    Fewer than ``k`` candidates give fewer rows; an empty table none. Scores are exact while the sum of
    their terms' magnitudes is under 2 ** 53, rounded to a double beyond, and end at the range of a long. Other columns are ignored.

    Candidates are ranged by length over partitions once and written as packed buckets. Queries come
    to the driver ``block`` at a time (``block`` vectors bound what it holds and broadcasts) and each
    block meets all buckets. Floors from the ids with the longest vectors, one of each, found beforehand, let the
    tasks prune from their first bucket on; each task gives ``k`` rows a query at most.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    whole = written(integer_vectors(rows, id_col, vector_col, scale), "vectors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_ids, held = None, [], []

        def flushed():
            out = packed(np.array(held_ids, np.int64), np.array(held, float).reshape(len(held), -1))
            held_ids.clear(), held.clear()
            return pa.RecordBatch.from_pylist([{"part": 0, **out}], pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (i, v) == last:
                    continue
                if held and (len(held) == bucket or len(held[0]) != len(v)):
                    yield flushed()
                last = (i, v)
                held_ids.append(i)
                held.append(v)
        if held:
            yield flushed()

    parts = shuffle_width(spark)
    ranged = whole.withColumn("dim", F.size("v")).repartitionByRange(parts, "dim", F.col("norm2").desc(), "vec_id").sortWithinPartitions("dim", F.col("norm2").desc(), "vec_id", "v")
    buckets = written(ranged.select("vec_id", "v").mapInArrow(pack, _CANDIDATES), "buckets")
    longest = {}
    for dim in [r[0] for r in buckets.select("dim").distinct().collect()]:
        own = whole.filter(F.size("v") == dim)
        ids = own.groupBy("vec_id").agg(F.max("norm2").alias("n")).orderBy(F.col("n").desc(), "vec_id").limit(bucket)
        top = own.join(F.broadcast(ids.withColumnRenamed("vec_id", "i")), (F.col("vec_id") == F.col("i")) & (F.col("norm2") == F.col("n"))).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
        longest[dim] = (np.array([r["vec_id"] for r in top]), np.array([r["v"] for r in top], float).reshape(len(top), dim))

    def floors(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        c_ids, c = longest[q.shape[1]]
        out = np.full(len(q), -np.inf)
        for at in range(0, len(q), 1024):
            s = q[at : at + 1024] @ c.T
            s[ids[at : at + 1024][:, None] == c_ids[None]] = -np.inf
            if s.shape[1] >= k:
                out[at : at + 1024] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        return out

    def against(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        shared = sc.broadcast((ids, q, floors(ids, q)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q, floor = shared.value
            q_len, best = np.sqrt((q * q).sum(axis=1)), Best(len(q), k)
            for b in batches:
                for dim, c_ids, c in zip(*(b.column(n).to_pylist() for n in ("dim", "ids", "vectors"))):
                    if dim == q.shape[1]:
                        c_ids, c = unpacked(dim, c_ids, c)
                        search_bucket(best, q_ids, q, q_len, floor, c_ids, c, np.sqrt((c * c).sum(axis=1)), high, focus)
            row, col = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(best.ids[row, col]), pa.array(np.clip(best.scores[row, col], -_MOST, _MOST).astype(np.int64))], ["query_id", "vec_id", "score"])

        return written(buckets.mapInArrow(run, _FOUND), "found")

    found, held = [], {}
    for r in whole.filter(is_query).select("vec_id", "v").distinct().toLocalIterator():
        held.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        if len(held[len(r["v"])]) == block:
            ids, vs = zip(*held.pop(len(r["v"])))
            found.append(against(np.array(ids), np.array(vs, float)))
    found += [against(np.array([i for i, _ in x]), np.array([v for _, v in x], float).reshape(len(x), -1)) for x in held.values()]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = spark.read.schema(found[0].schema).parquet(*[f.scratch_path for f in found])
    best_of = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best_of.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
