import math

import numpy as np
import pyarrow.parquet as pq
from oracle import check_same
from pyspark.sql import functions as F

from normcast.functions import circuits as C
from normcast.operators import assess as A
from normcast.operators import behavior as B
from normcast.operators import detectors as D
from normcast.operators import metrics as M
from normcast.operators import quantum as Q
from normcast.operators import similarity as N
from normcast.operators import transforms as X
from normcast.plans import catalog, oracles


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, 1, 1), (2, 0.8, 0, 1), (3, 0.8, 1, 1), (4, 0.1, 0, 0)], "id int, s double, y int, p int")
    assert M.roc_auc(df, "s", "y").first()[0] == 0.875
    assert abs(M.average_precision(df, "s", "y").first()[0] - (1 * 0.5 + (2 / 3) * 0.5)) < 1e-12
    r = M.rates(df, "y", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["n_errors"], r["accuracy"]) == (2, 1, 0, 1, 1, 0.75)
    only = df.filter("y = 0")
    assert M.roc_auc(only, "s", "y").first()[0] is None and M.average_precision(only, "s", "y").first()[0] is None
    assert {x["class"]: x["recall"] for x in M.class_report(only, "y", "p").collect()}["1"] == 0.0


def test_past_only_features_ignore_the_future(spark):
    rows = [(i, i % 3, float(i), float((i * 7) % 11)) for i in range(30)]
    later = [(i, a, t, v + (1000 if t > 15 else 0)) for i, a, t, v in rows]
    got = []
    for r in (rows, later):
        df = spark.createDataFrame(r, "id long, account long, t double, v double")
        got.append([x for x in B.amount_deviation(df, "account", "t", "id", "v").filter("t <= 15").orderBy("id").select("id", "amount_deviation").collect()])
    assert got[0] == got[1]


def test_vector_operators(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    x[0] = 9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = {(r["id"], r["rank"]): r["other"] for r in N.nearest(df, "id", "v", 3, size=16).collect()}
    assert all(near[i, k + 1] == np.argsort(d[i])[k] for i in range(60) for k in range(3))
    gram = N.rbf_gram(df, "id", "v", 0.1, size=16).collect()
    assert len(gram) == 60 * 61 // 2
    for scored, name in ((N.local_outlier_factor(df, "id", "v", 5), "lof"), (D.isolation_forest(df, "id", "v", trees=20, sample=32), "score"), (D.one_class_svm(df, "id", "v", gamma=0.1, nu=0.1), "score"), (D.pca_reconstruction(df.filter("id > 0"), "id", "v", components=2), "error")):
        top = scored.orderBy(F.col(name).desc()).first()
        assert name == "error" or top["id"] == 0
    assert abs(D.path_constant(256) - 10.2448) < 1e-3
    wide = df.select("id", *[F.col("v")[i].alias(f"V{i}") for i in range(3)])
    total = D.mahalanobis(wide, ["V0", "V1", "V2"]).agg(F.sum("distance")).first()[0]
    assert abs(total - 180) < 1e-6
    scores, share = X.pca(wide, ["V0", "V1", "V2"], 3)
    assert abs(share.sum() - 1) < 1e-9 and scores.count() == 60
    whole, share_too = X.vector_pca(df, "v", 3)
    assert np.allclose(share, share_too)
    names = ["pc1", "pc2", "pc3"]
    assert np.allclose(*(np.array([[r[n] for n in names] for r in f.orderBy("id").collect()]) for f in (scores, whole)), atol=1e-8)


def test_one_class_dual_holds_its_constraints():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    gram = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    a, rho = D.solve_one_class(gram, 0.2)
    assert abs(a.sum() - 1) < 1e-9 and a.min() >= -1e-12 and a.max() <= 1 / 16 + 1e-9
    assert (gram @ a < rho - 1e-5).mean() <= 0.2 + 1e-9


def test_circuits_by_hand():
    s = C.zz_state(np.array([[0.3]]), 1)
    assert np.allclose(s, np.array([[1, np.exp(0.6j)]]) / np.sqrt(2))
    two = C.zz_state(np.array([[0.3, 1.1]]), 1)[0]
    zz = 2 * (np.pi - 0.3) * (np.pi - 1.1)
    assert np.allclose(two, np.exp(1j * np.array([0, 0.6 + zz, 2.2 + zz, 2.8])) / 2)
    states = C.zz_state(np.random.default_rng(0).normal(size=(5, 3)))
    k = C.fidelity(states, states)
    assert np.allclose(np.diag(k), 1) and np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9
    r = C.real_amplitudes_state(np.zeros(6), 2, 2)
    assert np.allclose(r, [1, 0, 0, 0]) and np.isclose(np.linalg.norm(C.real_amplitudes_state(np.arange(12), 2)), 1)
    assert C.swap_test_one(r, r) == 0 and C.domain_wall(3, 2).argmax() == 4
    assert np.allclose(np.linalg.norm(C.amplitude_encoding(np.ones((2, 3))), axis=1), 1)


def test_assessment(spark):
    p = A.Policy("v", (("NORMAL", 0.0), ("HIGH", 2.0)))
    df = spark.createDataFrame([(1, 7, 2.5), (2, 7, 1.0), (3, 8, None), (4, 7, 3.0)], "id int, account int, score double")
    rows = A.assessed(df, "score", p)
    assert {r["id"]: r["level"] for r in rows.collect()} == {1: "HIGH", 2: "NORMAL", 3: None, 4: "HIGH"}
    c = A.cases(rows, "account", "score", "level", ["HIGH"]).first()
    assert (c["n"], c["priority"]) == (2, 3.0)
    many = spark.range(3000).select("id", F.lit(7).alias("account"), F.lit("HIGH").alias("level"))
    assert A.case_members(many, "account", "id", "level", ["HIGH"]).distinct().count() == 3000


def test_supervised_scores_every_row(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y), int(x + y > 0)) for i, (x, y) in enumerate(rng.normal(size=(80, 2)))]
    train = spark.createDataFrame(rows, "id long, a double, b double, y int")
    more = spark.createDataFrame([(100, None, 1.0, 1), (101, float("nan"), 1.0, None), (102, 3.0, 3.0, None), (103, -3.0, -3.0, None)], train.schema)
    for kind in ("logistic", "boosted"):
        p = {r["id"]: r["probability"] for r in D.supervised(train.union(more), more, ["a", "b"], "y", kind).collect()}
        assert p[100] is None and p[101] is None and p[102] > 0.8 and p[103] < 0.2


def test_fits_without_labels_read_all_rows(spark):
    """The mean and covariance of all rows, not of a sample of them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.1]]) + [3, -1, 1e6]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(7)
    n, mean, cov = D.vector_moments(df, "v")
    assert n == 500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)
    error = {r["id"]: r["error"] for r in D.pca_reconstruction(df.filter("v IS NOT NULL"), "id", "v", components=1).collect()}
    vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:1]
    z = x - x.mean(axis=0)
    assert np.allclose([error[i] for i in range(500)], ((z - z @ vt.T @ vt) ** 2).mean(axis=1), atol=1e-6)
    y = rng.normal(size=(400, 2))
    y[:60] = rng.normal(size=(60, 2)) * 0.1 + 12
    wide = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "id long, a double, b double")
    d = {r["id"]: r["distance"] for r in D.elliptic_envelope(wide, "id", ["a", "b"], most=100).collect()}
    assert min(d[i] for i in range(60)) > max(d[i] for i in range(60, 400))


def test_latent_classifier_and_kernel_machine(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * 0.3 + (2 if i % 4 == 0 else 0)).tolist(), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    got = D.latent_classifier(df.filter("id < 150"), df.filter("id >= 150").union(spark.createDataFrame([(500, None, None)], df.schema)), "id", "v", "y", sizes=(8, 4, 8), rounds=5).collect()
    assert len(got) == 51 and all((r["probability"] > 0.5) == (r["id"] % 4 == 0) if r["id"] != 500 else r["probability"] is None for r in got)
    x = rng.normal(size=(60, 2))
    y = np.where((x**2).sum(axis=1) > 1.2, 1.0, -1.0)
    gram = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    w, b = Q.solve_two_class(gram, y, 10.0)
    assert abs(w.sum()) < 1e-9 and (np.abs(w) <= 10 + 1e-9).all() and (y * w >= -1e-12).all()
    margin = y * (gram @ w + b)
    assert (margin[(np.abs(w) > 1e-6) & (np.abs(w) < 10 - 1e-6)].round(2) == 1).all() and (margin > 0).mean() > 0.95
    near = C.fidelity(C.zz_state(x), C.zz_state(x[:1]))[:, 0]  # parted by a plane of the kernel's space
    rows = spark.createDataFrame([(i, v.tolist(), int(k > np.median(near))) for i, (v, k) in enumerate(zip(x, near))], "id long, v array<double>, y int")
    scored = Q.kernel_svm(rows, rows, "id", "v", "y", cost=1000.0).collect()
    assert np.mean([(r["score"] > 0) == (r["y"] == 1) for r in scored]) > 0.95


def test_kernel_blocks_and_experiment_log(spark, tmp_path):
    df = spark.createDataFrame([(i, [i / 10, 1 - i / 7]) for i in range(12)], "id long, v array<double>")
    one, many = ({(r["id"], r["anchor"]): r["k"] for r in Q.zz_kernel(df, df.filter("id < 7"), "id", "v", block=b).collect()} for b in (100, 2))
    assert set(one) == set(many) and len(one) == 84 and all(abs(many[x] - k) < 1e-9 for x, k in one.items())
    assert Q.zz_kernel(df, df.limit(0), "id", "v").count() == 0
    A.log_experiment(spark, f"{tmp_path}/log", id="a", seed=3, metrics={"auc": 0.5})
    A.log_experiment(spark, f"{tmp_path}/log", id="b", hypothesis="h")
    got = {r["id"]: r for r in A.experiments(spark, f"{tmp_path}/log").collect()}
    assert got["a"]["metrics"] == '{"auc": 0.5}' and got["a"]["seed"] == "3" and got["b"]["hypothesis"] == "h"


def test_hours_that_cancel_out_equal_sql(spark, tmp_path):
    rows = [(3 * m + k, m, (m + 720 * k) % 1440 if k < 2 else (m * 7) % 1440, k) for m in range(720) for k in range(3)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, minute int, day int")
    table.selectExpr("event_id", "user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(day, 0, minute, 0) AS ts", "'view' AS event_type", "1D AS value").write.parquet(str(tmp_path / "events.parquet"))
    check_same(catalog.q_temporal_deviation(spark, str(tmp_path)), str(tmp_path), oracles.oracle_sql()["q_temporal_deviation"])


def test_amounts_at_a_quantile_equal_sql(spark, tmp_path):
    # an amount where the quantile between the two least of n earlier ones lies, but for rounding
    lives = [[a / 100, *[(a + d) / 100] * (n - 1), round(a + d * (n - 1) * 0.05) / 100] for n in (3, 6, 7, 9, 13) for a in range(0, 900, 15) for d in (20, 40, 100)]
    rows = [(100 * u + k, u, x) for u, life in enumerate(lives) for k, x in enumerate(life)]
    rows += [(900_000 + i, 9_000, x) for i, x in enumerate([1.0, None, float("nan"), 2.0, float("inf"), 0.5, None, float("nan"), 3.0])]
    table = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    table.selectExpr("event_id", "user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id) AS ts", "'view' AS event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.q_normal_range(spark, str(tmp_path))
    check_same(got.filter("event_id < 900000"), str(tmp_path), f"SELECT * FROM ({oracles.oracle_sql()['q_normal_range']}) WHERE event_id < 900000")
    at = {r["event_id"] - 900_000: r for r in got.filter("event_id >= 900000").collect()}
    assert at[0]["low"] is None and at[0]["out_of_range"] == 0 and at[2]["low"] == at[2]["high"] == 1.0 and at[2]["out_of_range"] == 1
    assert np.isnan(at[3]["high"]) and at[5]["low"] < 2 and at[6]["low"] > 0.5 and at[8]["out_of_range"] == 0


def test_reconstruction_errors_keep_their_bits_in_any_batch(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(300)] + [(300, None), (301, [None] * 64), (302, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    scored = D.pca_reconstruction(df, "id", "v", components=8)
    before, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append({r["id"]: r["error"] for r in scored.select("id", "error").collect()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] == got[2] and [got[0][i] for i in (300, 301, 302)] == [None] * 3
    flags = {r["id"]: r["prediction"] for r in D.flagged(scored, "error", 0.1).collect()}
    assert sum(flags[i] for i in range(300)) == 30 and flags[300] is None


def test_blocks_meet_without_shuffling_their_pairs(spark):
    rng = np.random.default_rng(9)
    x = {i: rng.normal(size=6) for i in range(150)}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in x.items()], "id long, v array<double>")
    gram = N.rbf_gram(df, "id", "v", 0.1, size=8)
    plan = gram._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("CartesianProduct")]
    assert "Exchange" not in above and "Broadcast" not in plan
    got = {(r["i"], r["j"]): r["k"] for r in gram.collect()}
    assert len(got) == 150 * 151 // 2 and all(i <= j and abs(k - np.exp(-0.1 * ((x[i] - x[j]) ** 2).sum())) < 1e-12 for (i, j), k in got.items())


def test_rounded_kernel_is_written_as_indices_of_a_dictionary(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)) / 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    N.rbf_gram(df, "id", "v", 0.5, size=512, decimals=6).coalesce(1).write.parquet(str(tmp_path / "gram"))
    (file,) = (tmp_path / "gram").glob("*.parquet")
    table = pq.read_table(file)
    i, j, k = (table.column(c).to_numpy() for c in "ijk")
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i) == 2000 * 2001 // 2 and (i <= j).all()
    exact = np.exp(-0.5 * ((x[i] - x[j]) ** 2).sum(axis=1))
    assert (np.abs(k - exact) < 0.5000001e-6).all() and (k == np.round(k, 6)).all() and len(np.unique(k)) > 1 << 17
    meta = pq.ParquetFile(file).metadata
    columns = [meta.row_group(g).column(c) for g in range(meta.num_row_groups) for c in range(3)]
    assert not any("PLAIN" in c.encodings for c in columns)
    assert sum(c.total_compressed_size for c in columns) < 6 * len(i)


def test_rounded_kernel_finds_values_near_a_half_again():
    rng = np.random.default_rng(4)

    def in_order(x, y):
        total = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            total += (x[:, None, c] - y[None, :, c]) ** 2
        scaled = np.exp(-0.5 * np.sqrt(total) ** 2) * 1e6
        return np.floor(scaled + 0.5) / 1e6

    near = rng.normal(size=(200, 8)) / 3
    for far in (0, 1e3, 1e7):
        x = near + far
        assert (N._rounded_kernel(x[:90], x, 0.5, 6) == in_order(x[:90], x)).all()
    # pairs at distances whose values lie within 1e-15 of a half, on either side
    halves = np.sqrt(-2 * np.log((rng.integers(1, 10**6, 300) - 0.5) / 1e6))[:, None]
    assert (N._rounded_kernel(np.zeros((1, 1)), halves, 0.5, 6) == np.array([[np.floor(s) + (s % 1 >= 0.5) for s in (math.exp(-0.5 * v**2) * 1e6 for v in halves[:, 0].tolist())]]) / 1e6).all()
    odd = N._rounded_kernel(np.array([[np.inf], [np.nan], [1e200]]), np.array([[0.0]]), 0.5, 6)[:, 0]
    assert odd[0] == 0 and np.isnan(odd[1]) and odd[2] == 0


def test_block_meets_itself_in_another_order(monkeypatch):
    monkeypatch.setattr(N, "_met", lambda rows, id_col, vector, per_pair, *a, **b: per_pair)
    kernel = N.rbf_gram(None, "id", "v", 0.1)
    ids, x = np.arange(40), np.random.default_rng(5).normal(size=(40, 3))
    other = np.random.default_rng(6).permutation(40)
    got = [(r["i"], r["j"]) for batch in kernel(ids, ids[other], x, x[other]) for r in batch.to_pylist()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(i, 40)]
