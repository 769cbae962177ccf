"""Outlier detectors: closed forms as expressions, fitted models on stated, bounded samples, scoring over all rows.

Scores are larger for stranger rows. Formulas follow the published papers; no other library's output is matched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normcast.functions.scalar import ratio, salted_rank_key
from normcast.operators.ordered import kth_values, percentiles


def zscore(df: DataFrame, column: str, out: str = "z") -> DataFrame:
    fit = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, ratio(F.col(column) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def robust_flags(df: DataFrame, column: str) -> DataFrame:
    """Tukey fences (1.5 interquartile ranges) and the modified z-score over the median absolute deviation."""
    low, middle, high = percentiles(df, column, [0.25, 0.5, 0.75])
    (mad,) = percentiles(df.select(F.abs(F.col(column) - F.lit(middle)).alias("d")), "d", [0.5])
    x = F.col(column)
    if middle is None:
        return df.withColumn("outside", F.lit(None).cast("int")).withColumn("mad_z", F.lit(None).cast("double"))
    outside = (x < low - 1.5 * (high - low)) | (x > high + 1.5 * (high - low))
    return df.withColumn("outside", outside.cast("int")).withColumn("mad_z", ratio(0.6745 * (x - middle), F.lit(mad)))


def mahalanobis(df: DataFrame, columns: Sequence[str], out: str = "distance") -> DataFrame:
    """Squared distance from the mean under the population covariance; one aggregate, then an expression.

    A covariance that can't be inverted counts by its pseudo-inverse. Distances sum to rows times rank.
    """
    mean, cov = mean_and_covariance(df, columns)
    return _quadratic(df, columns, mean, np.linalg.pinv(cov), out)


def mean_and_covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of all rows, by one aggregate."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(d)]), cov


def _quadratic(df: DataFrame, columns: Sequence[str], mean: np.ndarray, inverse: np.ndarray, out: str) -> DataFrame:
    z = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean)]
    terms = [z[i] * z[j] * F.lit(float(inverse[i, j] * (1 if i == j else 2))) for i in range(len(z)) for j in range(i, len(z))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def sample_rows(df: DataFrame, id_col: str, columns: Sequence[str] | str, most: int, seed: int) -> np.ndarray:
    """The ``most`` rows first in hash order, as a matrix: the bound of what a fit holds on the driver."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    got = df.select(id_col, *cols).orderBy(salted_rank_key(F.col(id_col), seed), id_col).limit(most).drop(id_col).toPandas()
    return np.stack(got[cols[0]].to_numpy()).astype(float) if isinstance(columns, str) and len(got) else got.to_numpy(float)


def elliptic_envelope(df: DataFrame, id_col: str, columns: Sequence[str], *, support: float = 0.7, most: int = 20_000, seed: int = 12345, starts: int = 10, out: str = "distance") -> DataFrame:
    """Squared distance under a minimum covariance determinant fit (Rousseeuw and Van Driessen 1999).

    Starts and first steps run on at most ``most`` rows on the driver; the best of them is then carried on over all rows, each step an exact
    order statistic and one aggregate, until the determinant falls no more. Rows with a missing value take no part in the fit.
    """
    rows = df.dropna(subset=list(columns))
    x = sample_rows(rows, id_col, columns, most, seed)
    if not len(x):
        return df.withColumn(out, F.lit(None).cast("double"))
    rng, h, best = np.random.default_rng(seed), max(x.shape[1] + 1, int(support * len(x))), (np.inf, None, None)
    for _ in range(starts):
        pick = x[rng.choice(len(x), min(len(x), x.shape[1] + 1), replace=False)]
        for _ in range(30):
            mean, cov = pick.mean(axis=0), np.atleast_2d(np.cov(pick.T, bias=True))
            inv = np.linalg.pinv(cov + 1e-12 * np.eye(len(cov)))
            z = x - mean
            chosen = x[np.argsort(np.einsum("ij,jk,ik->i", z, inv, z), kind="stable")[:h]]
            if np.array_equal(chosen, pick):
                break
            pick = chosen
        sign, det = np.linalg.slogdet(np.atleast_2d(np.cov(pick.T, bias=True)) + 1e-12 * np.eye(x.shape[1]))
        if det < best[0]:
            best = (det, pick.mean(axis=0), np.linalg.pinv(np.atleast_2d(np.cov(pick.T, bias=True))))
    n, last, mean, inverse = rows.count(), np.inf, best[1], best[2]
    h = min(n, max(x.shape[1] + 1, int(support * n)))
    for _ in range(30):
        measured = _quadratic(rows.select(*columns), columns, mean, inverse, "__d")
        limit = kth_values(measured, "__d", [h - 1])[h - 1][0]
        new_mean, cov = mean_and_covariance(measured.filter(F.col("__d") <= F.lit(limit)), columns)
        det = np.linalg.slogdet(cov + 1e-12 * np.eye(len(cov)))[1]
        if not det < last - 1e-9:
            break
        last, mean, inverse = det, new_mean, np.linalg.pinv(cov)
    return _quadratic(df, columns, mean, inverse, out)


def path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth value of a leaf)."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            nodes[at] = (-1, 0.0, -1, -1, depth + path_constant(len(rows)))
            return at
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        low = rows[:, f] < cut
        if not low.any():
            low = rows[:, f] <= rows[:, f].min()
        nodes[at] = (f, cut, grow(rows[low], depth + 1), grow(rows[~low], depth + 1), 0.0)
        return at

    grow(x, 0)
    return nodes


def isolation_forest(df: DataFrame, id_col: str, vector: str, *, trees: int = 100, sample: int = 256, seed: int = 101, most: int = 100_000, out: str = "score") -> DataFrame:
    """Isolation score 2 ** (-mean depth / c(sample)) (Liu et al. 2008). Trees grow in tasks of their own from a bounded pool."""
    pool = sample_rows(df, id_col, vector, min(most, trees * sample), seed)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(pool)
    psi = min(sample, len(pool))

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"]:
                rng = np.random.default_rng([seed, int(t)])
                rows = shared.value[rng.choice(len(shared.value), psi, replace=False)]
                nodes = _grow(rows, rng, max(1, int(np.ceil(np.log2(max(2, psi))))))
                yield pd.DataFrame([(int(t), i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    grown = spark.range(trees).repartition(min(trees, 32)).mapInPandas(plant, "tree long, node long, feature long, cut double, left long, right long, depth double").toPandas() if psi else pd.DataFrame()
    forest = [g.sort_values("node")[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, g in grown.groupby("tree")] if psi else []
    held = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        if not len(vectors) or not held.value:
            return pa.nulls(len(vectors), pa.float64())
        x = np.array(vectors.to_pylist(), float)
        depth = np.zeros(len(x))
        for t in held.value:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                low = x[inner, f[inner]] < t[at[inner], 1]
                at[inner] = np.where(low, t[at[inner], 2], t[at[inner], 3]).astype(int)
            depth += t[at, 4]
        return pa.array(2.0 ** (-depth / len(held.value) / max(path_constant(psi), 1e-9)))

    return df.withColumn(out, score(vector))


def solve_one_class(gram: np.ndarray, nu: float, rounds: int = 20_000, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and offset of the one-class dual (Scholkopf et al. 2001): pairwise steps on the most violating pair."""
    n = len(gram)
    top = 1 / (nu * n)
    a = np.zeros(n)
    full = int(nu * n)
    a[:full] = top
    if full < n:
        a[full] = 1 - full * top
    g = gram @ a
    for _ in range(rounds):
        up, down = np.where(a < top - 1e-12, g, np.inf), np.where(a > 1e-12, g, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if g[j] - g[i] < tolerance:
            break
        step = min((g[j] - g[i]) / max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12), top - a[i], a[j])
        a[i] += step
        a[j] -= step
        g += step * (gram[i] - gram[j])
    free = (a > 1e-9) & (a < top - 1e-9)
    return a, float(g[free].mean() if free.any() else (g[a > 1e-9].max() if (a > 1e-9).any() else 0.0))


def one_class_svm(df: DataFrame, id_col: str, vector: str, *, gamma: float | None = None, nu: float = 0.05, most: int = 2_000, seed: int = 42, where: Column | None = None, out: str = "score") -> DataFrame:
    """Offset less the decision sum: over 0 is an outlier. The exact dual is fitted on at most ``most`` rows; a linear kernel without ``gamma``."""
    x = sample_rows(df if where is None else df.filter(where), id_col, vector, most, seed)

    def kernel(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        if gamma is None:
            return u @ v.T
        return np.exp(-gamma * np.maximum(0, (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T))

    a, rho = solve_one_class(kernel(x, x), nu)
    keep = a > 1e-12
    held = df.sparkSession.sparkContext.broadcast((x[keep], a[keep], rho))

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        s, w, r = held.value
        return pa.array(r - kernel(np.array(vectors.to_pylist(), float), s) @ w) if len(vectors) else pa.array([], pa.float64())

    return df.withColumn(out, score(vector))


def vector_moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance of a vector column, over all rows with a whole vector.

    Every partition sums its vectors about the first vector of the table; sums by place are added up, so one row for each place returns.
    """
    sound = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")
    first = sound.first()
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    base = np.array(first["v"])
    d = len(base)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + d * d)
        for b in batches:
            if b.num_rows:
                z = np.array(b.column(0).to_pylist()).reshape(b.num_rows, d) - base
                total += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "s": total})

    got = sound.filter(F.size("v") == d).mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    n, mean = got[0], got[1 : 1 + d] / got[0]
    return int(n), base + mean, got[1 + d :].reshape(d, d) / n - np.outer(mean, mean)


def _added(x: np.ndarray) -> np.ndarray:
    """Sums over the first axis, one row after the other: a column's sum has the same bits whatever columns are beside it.

    Spark may run a function twice, once in a filter and once on what passes; products of whole matrices differ in their
    last bits from batch to batch.
    """
    total = np.zeros(x.shape[1])
    for row in x:
        total += row
    return total


def pca_reconstruction(df: DataFrame, id_col: str, vector: str, *, components: int, where: Column | None = None, out: str = "error") -> DataFrame:
    """Mean squared error of the projection on the leading components, fitted on all rows (those of ``where``): the linear autoencoder's optimum.

    Null of a vector that is null, holds null or NaN or has another length.
    """
    n, mean, cov = vector_moments(df if where is None else df.filter(where), vector)
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    values, vectors = np.linalg.eigh(cov)
    held = df.sparkSession.sparkContext.broadcast((mean, vectors[:, np.argsort(-values)[:components]].T))

    @F.arrow_udf("double")
    def error(vectors: pa.Array) -> pa.Array:
        m, v = held.value
        found = vectors.to_pylist()
        sound = np.array([x is not None and len(x) == len(m) and None not in x for x in found], bool)
        z = (np.array([x for x, ok in zip(found, sound) if ok], float).reshape(-1, len(m)) - m).T
        rest = z.copy()
        for axis in v:
            rest -= axis[:, None] * _added(axis[:, None] * z)
        out = np.full(len(found), np.nan)
        out[sound] = _added(rest * rest) / len(m)
        return pa.array(out, mask=np.isnan(out))

    return df.withColumn(out, error(vector))


def self_organizing_map(df: DataFrame, id_col: str, vector: str, *, side: int = 10, rounds: int = 100, sigma: float = 1.0, rate: float = 0.5, most: int = 5_000, seed: int = 42) -> DataFrame:
    """``winner`` (cell) and ``quantization_error`` of each row on a map fitted to a sample, and ``cell_distance``: the
    winner's mean distance to its neighbours over the largest such mean."""
    x = sample_rows(df, id_col, vector, most, seed)
    rng = np.random.default_rng(seed)
    cells = np.array([(i, j) for i in range(side) for j in range(side)], float)
    w = x[rng.choice(len(x), side * side, replace=len(x) < side * side)].copy()
    for t in range(rounds):
        v = x[rng.integers(len(x))]
        fade = 1 + t / (rounds / 2)
        best = ((w - v) ** 2).sum(axis=1).argmin()
        near = np.exp(-((cells - cells[best]) ** 2).sum(axis=1) / (2 * (sigma / fade) ** 2))
        w += (rate / fade) * near[:, None] * (v - w)
    apart = np.abs(cells[:, None] - cells[None]).max(axis=2) == 1
    distance = np.array([np.sqrt(((w[apart[i]] - w[i]) ** 2).sum(axis=1)).mean() for i in range(len(w))])
    held = df.sparkSession.sparkContext.broadcast((w, distance / max(distance.max(), 1e-300)))

    @F.arrow_udf("struct<winner:int,quantization_error:double,cell_distance:double>")
    def place(vectors: pa.Array) -> pa.Array:
        w, d = held.value
        z = np.array(vectors.to_pylist(), float).reshape(len(vectors), w.shape[1])
        d2 = (z * z).sum(1)[:, None] + (w * w).sum(1)[None] - 2 * z @ w.T
        best = d2.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(np.sqrt(np.maximum(0, d2[np.arange(len(z)), best]))), pa.array(d[best])], ["winner", "quantization_error", "cell_distance"])

    return df.withColumn("__p", place(vector)).select("*", "__p.*").drop("__p")


def flagged(df: DataFrame, score: str, contamination: float, out: str = "prediction") -> DataFrame:
    """1 for scores over the exact (1 - contamination) percentile."""
    (cut,) = percentiles(df, score, [1 - contamination])
    return df.withColumn(out, (F.col(score) > F.lit(cut)).cast("int"))


def supervised(train: DataFrame, rows: DataFrame, columns: Sequence[str], label: str, kind: str = "logistic", **settings) -> DataFrame:
    """``probability`` of the positive class by Spark's logistic regression or gradient-boosted trees.

    Rows with a missing feature teach nothing and have no probability; every row of ``rows`` is returned.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = {use: VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid=use) for use in ("skip", "keep")}
    make = {"logistic": LogisticRegression, "boosted": GBTClassifier}[kind]
    model = make(featuresCol="__x", labelCol=label, **settings).fit(ready["skip"].transform(train.filter(F.col(label).isNotNull())))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    scored = model.transform(ready["keep"].transform(rows.withColumn("__whole", whole)))
    p = F.when(F.col("__whole"), vector_to_array("probability")[1])
    return scored.withColumn("__p", p).drop("__x", "__whole", "rawPrediction", "probability", "prediction").withColumnRenamed("__p", "probability")


def encoder_weights(x: np.ndarray, sizes: Sequence[int], rounds: int, seed: int, rate: float = 1e-3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers (weights, offsets) of a dense autoencoder with hidden layers of these sizes and an output like ``x``: hyperbolic tangents but for
    the output, which is linear; squared error, batches of 32, Adam."""
    rng = np.random.default_rng(seed)
    dims = [x.shape[1], *sizes, x.shape[1]]
    layers = [[rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros(b)] for a, b in zip(dims, dims[1:])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for layer in layers for p in layer]
    t = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            outs = [x[order[at : at + 32]]]
            for k, (w, b) in enumerate(layers):
                z = outs[-1] @ w + b
                outs.append(np.tanh(z) if k + 1 < len(layers) else z)
            g = 2 * (outs[-1] - outs[0]) / outs[0].size
            grads = []
            for k in range(len(layers) - 1, -1, -1):
                if k + 1 < len(layers):
                    g = g * (1 - outs[k + 1] ** 2)
                grads += [g.sum(axis=0), outs[k].T @ g]
                g = g @ layers[k][0].T
            t += 1
            for i, grad in enumerate(reversed(grads)):
                m, v = moments[i]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                layers[i // 2][i % 2] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return [(w, b) for w, b in layers]


def latent_classifier(train: DataFrame, rows: DataFrame, id_col: str, vector: str, label: str, *, sizes: Sequence[int] = (50, 25, 50), normals: int = 2_000, rounds: int = 10, seed: int = 42) -> DataFrame:
    """``probability`` of the positive class of every row, by logistic regression on the middle layer of an autoencoder.

    The autoencoder is fitted on at most ``normals`` labelled normal rows (the first by hash), scaled to 0..1 by their range; the regression on all
    of ``train``. Every row of ``rows`` is returned, those without a whole vector with no probability.
    """
    x = sample_rows(train.filter(F.col(label) == 0).filter(F.col(vector).isNotNull()), id_col, vector, normals, seed)
    low, high = x.min(axis=0), x.max(axis=0)
    span = np.where(high > low, high - low, 1.0)
    middle = len(sizes) // 2 + 1
    held = rows.sparkSession.sparkContext.broadcast((low, span, encoder_weights((x - low) / span, sizes, rounds, seed)[:middle]))

    @F.arrow_udf("array<double>")
    def latent(vectors: pa.Array) -> pa.Array:
        low, span, layers = held.value
        out = []
        for v in vectors.to_pylist():
            whole = v is not None and len(v) == len(low) and None not in v
            out.append(v if whole else [np.nan] * len(low))
        z = (np.array(out, float).reshape(len(out), len(low)) - low) / span
        for w, b in layers:
            z = np.tanh(z @ w + b)
        return pa.array(list(z), pa.list_(pa.float64()))

    d = sizes[middle - 1]
    names = [f"__z{i}" for i in range(d)]
    both = [f.withColumn("__l", latent(vector)).withColumns({n: F.col("__l")[i] for i, n in enumerate(names)}).drop("__l") for f in (train, rows)]
    return supervised(*both, names, label).drop(*names)
