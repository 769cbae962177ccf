"""Kernels of simulated feature maps, and the one-class machine on them, for small feature counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normcast.functions.circuits import fidelity, resources, zz_state
from normcast.operators.detectors import sample_rows, solve_one_class


def zz_kernel(rows: DataFrame, anchors: DataFrame, id_col: str, vector: str, repetitions: int = 2, block: int = 4_096) -> DataFrame:
    """``(id, anchor, k, backend, qubits)``: fidelity of every row with every anchor.

    Anchors come to the driver ``block`` at a time, which bounds what it holds and broadcasts.
    """
    out, held = None, []
    for r in anchors.select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy("i").toLocalIterator():
        held.append((r["i"], r["v"]))
        if len(held) == block:
            part = _against(rows, held, id_col, vector, repetitions)
            out, held = part if out is None else out.unionByName(part), []
    if held:
        part = _against(rows, held, id_col, vector, repetitions)
        out = part if out is None else out.unionByName(part)
    empty = f"id {rows.schema[id_col].dataType.simpleString()}, anchor {anchors.schema[id_col].dataType.simpleString()}, k double, backend string, qubits string"
    return out if out is not None else rows.sparkSession.createDataFrame([], empty)


def _against(rows: DataFrame, anchors: list[tuple], id_col: str, vector: str, repetitions: int) -> DataFrame:
    ids, x = [i for i, _ in anchors], np.array([v for _, v in anchors], float)
    spark = rows.sparkSession
    held, meta = spark.sparkContext.broadcast(zz_state(x, repetitions)), resources(x.shape[1], repetitions)
    names = spark.createDataFrame(list(enumerate(ids)), f"__n int, anchor {rows.schema[id_col].dataType.simpleString()}")

    @F.arrow_udf("array<double>")
    def against(vectors: pa.Array) -> pa.Array:
        return pa.array(list(fidelity(zz_state(np.array(vectors.to_pylist(), float), repetitions), held.value)), pa.list_(pa.float64())) if len(vectors) else pa.array([], pa.list_(pa.float64()))

    out = rows.select(F.col(id_col).alias("id"), F.posexplode(against(vector)).alias("__a", "k"))
    return out.join(F.broadcast(names), F.col("__a") == F.col("__n")).select("id", "anchor", "k", F.lit(meta["backend"]).alias("backend"), F.lit(meta["qubits"]).alias("qubits"))


def kernel_one_class(rows: DataFrame, id_col: str, vector: str, *, nu: float = 0.05, repetitions: int = 2, most: int = 500, seed: int = 42, out: str = "score") -> DataFrame:
    """The one-class machine on the simulated kernel, fitted on at most ``most`` rows: over 0 is an outlier."""
    x = zz_state(sample_rows(rows, id_col, vector, most, seed), repetitions)
    a, rho = solve_one_class(fidelity(x, x), nu)
    keep = a > 1e-12
    held = rows.sparkSession.sparkContext.broadcast((x[keep], a[keep], rho))

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        s, w, r = held.value
        return pa.array(r - fidelity(zz_state(np.array(vectors.to_pylist(), float), repetitions), s) @ w) if len(vectors) else pa.array([], pa.float64())

    return rows.withColumn(out, score(vector))


def solve_two_class(gram: np.ndarray, y: np.ndarray, cost: float, rounds: int = 20_000, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (signed by the class, -1 or 1) and offset of the two-class dual on a given kernel matrix: steps on the most violating pair."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    q = gram * np.outer(y, y)
    for _ in range(rounds):
        rise, fall = ((y > 0) & (a < cost - 1e-12)) | ((y < 0) & (a > 1e-12)), ((y < 0) & (a < cost - 1e-12)) | ((y > 0) & (a > 1e-12))
        up, down = np.where(rise, -y * g, -np.inf), np.where(fall, -y * g, np.inf)
        i, j = int(up.argmax()), int(down.argmin())
        if up[i] - down[j] < tolerance:
            break
        step = (up[i] - down[j]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        step = min(step, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * (q[:, i] * y[i] - q[:, j] * y[j])
    free = (a > 1e-9) & (a < cost - 1e-9)
    level = -y * g
    return a * y, float(level[free].mean() if free.any() else (level.max() + level.min()) / 2 if len(y) else 0.0)


def kernel_svm(train: DataFrame, rows: DataFrame, id_col: str, vector: str, label: str, *, cost: float = 1.0, repetitions: int = 2, most: int = 1_000, seed: int = 42, out: str = "score") -> DataFrame:
    """``rows`` with the decision value of a two-class machine on the precomputed simulated kernel: over 0 is class 1.

    Fitted on at most ``most`` labelled rows, the first by hash: their kernel matrix is what the driver holds. Labels are 0 and 1.
    """
    cols = [F.col(id_col), F.array(F.col(label).cast("double")).alias("__y"), F.col(vector).cast("array<double>").alias("__v")]
    xy = sample_rows(train.filter(F.col(label).isNotNull()).select(*cols).select(id_col, F.concat("__y", "__v").alias("__xy")), id_col, "__xy", most, seed)
    y, states = np.where(xy[:, 0] > 0, 1.0, -1.0), zz_state(xy[:, 1:], repetitions)
    w, offset = solve_two_class(fidelity(states, states), y, cost)
    keep = np.abs(w) > 1e-12
    held = rows.sparkSession.sparkContext.broadcast((states[keep], w[keep], offset))

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        s, w, r = held.value
        return pa.array(fidelity(zz_state(np.array(vectors.to_pylist(), float), repetitions), s) @ w + r) if len(vectors) else pa.array([], pa.float64())

    return rows.withColumn(out, score(vector))
