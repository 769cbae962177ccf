"""One query for each operator family, on the driver's tables. Stand-ins: events are transactions (user the
account, ts the time, value the amount, 'error' the positive class); orders, customers and nations give
places; line items give merchants; embeddings give feature vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normcast.functions import scalar as S
from normcast.operators import assess as A
from normcast.operators import behavior as B
from normcast.operators import detectors as D
from normcast.operators import metrics as M
from normcast.operators import profiling as P
from normcast.operators import quality as Q
from normcast.operators import quantum as K
from normcast.operators import similarity as N
from normcast.operators import splitting as L
from normcast.operators import transforms as X
from normcast.sources.tables import read_parquet, vector_columns
from normcast.streaming import twins as W

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEVELS = A.Policy("2024-1", (("NORMAL", float("-inf")), ("LOW", 1.0), ("MEDIUM", 2.0), ("HIGH", 3.0)))
RISK = A.Policy("2024-1", (("NORMAL", float("-inf")), ("ATTENTION", 2.0), ("HIGH_RISK", 4.0)))


def query(f: Callable) -> Callable:
    REGISTRY[f.__name__] = f
    return f


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_parquet(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))


def _split(spark: SparkSession, d: str) -> L.Split:
    return L.temporal_split(events(spark, d).select("event_id", "ts", "user_id", "event_type", "value", "y"), "ts", "event_id")


@query
def q_temporal_split_counts(spark, d):
    return _split(spark, d).rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query
def q_temporal_split_bounds(spark, d):
    return L.bounds(_split(spark, d).rows, "ts")


@query
def q_train_fit_scale(spark, d):
    split = _split(spark, d)
    rows = X.build_features(split, ["value"], target="y", amount="value", keep=["event_id", "ts"]).rows
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), r6(F.sum("value") + 0.0).alias("sum_z"), r6(F.sum(F.col("value") * F.col("value"))).alias("sum_z2"))


@query
def q_quality_report(spark, d):
    return Q.report(events(spark, d), "event_id", ["ts", "value", "event_type"], F.col("y"))


@query
def q_duplicate_keys(spark, d):
    return Q.duplicate_keys(read_parquet(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def q_quarantine(spark, d):
    rules = {"price_over_100": F.col("o_totalprice") > 100, "status_known": F.col("o_orderstatus").isin("O", "F"), "dated_from_1996": F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")}
    rows = Q.quarantine(read_parquet(spark, d, "orders"), rules).filter(F.size("reasons") > 0)
    return rows.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query
def q_out_of_order(spark, d):
    return Q.out_of_order(events(spark, d), "ts", "event_id", ["user_id"])


@query
def q_class_balance(spark, d):
    return rounded(P.class_balance(events(spark, d), F.col("y")), "percent", "contamination")


@query
def q_skewness_profile(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(P.skewness_profile(read_parquet(spark, d, "lineitem"), cols, {c: S.signed_log(F.col(c)) for c in cols}), "before", "after")


@query
def q_describe(spark, d):
    return rounded(P.describe(read_parquet(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "mean", "std", "std_population", "min", "median", "max")


@query
def q_signed_log(spark, d):
    return rounded(X.tame_skew(events(spark, d), ["value"]), "value").select("event_id", "value")


@query
def q_histogram_30(spark, d):
    return P.histogram(events(spark, d), "value", 30)


@query
def q_percentile_threshold(spark, d):
    return rounded(P.over_percentile(events(spark, d), "value", 0.9), "threshold")


@query
def q_median_impute(spark, d):
    rows = read_parquet(spark, d, "documents").join(read_parquet(spark, d, "labels"), "doc_id", "left").withColumn("quality", F.col("quality").cast("double"))
    return X.impute_median(rows, "quality").groupBy("quality").agg(F.count("*").alias("n"))


@query
def q_fixed_bins(spark, d):
    return X.fixed_bins(read_parquet(spark, d, "lineitem"), "l_quantity", "bin", [7.91, 14.454, 31.0]).groupBy("bin").agg(F.count("*").alias("n"))


@query
def q_quantile_bins(spark, d):
    return X.quantile_bins(read_parquet(spark, d, "lineitem"), "l_extendedprice", "bin").groupBy("bin").agg(F.count("*").alias("n"))


@query
def q_equal_width_bins(spark, d):
    return X.equal_width_bins(read_parquet(spark, d, "lineitem"), "l_quantity", "bin").groupBy("bin").agg(F.count("*").alias("n"))


@query
def q_minmax_scale(spark, d):
    return rounded(X.minmax_scale(read_parquet(spark, d, "orders"), ["o_totalprice"]), "o_totalprice").select("o_orderkey", "o_totalprice")


@query
def q_minmax_inverse(spark, d):
    scaled = X.minmax_scale(read_parquet(spark, d, "orders"), ["o_totalprice"], keep_fit=True)
    return X.minmax_inverse(scaled, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query
def q_hour_of_day(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    band = F.when(S.hour_of_day(seconds) < 6, "night").when(S.hour_of_day(seconds) < 12, "morning").when(S.hour_of_day(seconds) < 18, "afternoon").otherwise("evening")
    return events(spark, d).groupBy(band.alias("band"), F.dayofweek("ts").alias("weekday")).agg(F.count("*").alias("n"))


@query
def q_value_mapping(spark, d):
    o = read_parquet(spark, d, "orders")
    urgency = S.replaced(F.col("o_orderpriority"), {"high": ["1-URGENT", "2-HIGH"], "low": ["4-NOT SPECIFIED", "5-LOW"]})
    code = S.coded(F.col("o_orderstatus"), {"O": 1, "F": 2})
    return o.groupBy(urgency.alias("urgency"), code.alias("status_code"), S.flag(F.col("o_totalprice") > 1000).alias("is_large")).agg(F.count("*").alias("n"))


@query
def q_regex_extract(spark, d):
    p = read_parquet(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.length("url").alias("n_url"), S.flag(F.col("html").isNotNull()).alias("has_html"))


@query
def q_json_props(spark, d):
    return events(spark, d).groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query
def q_undersample_hash(spark, d):
    return L.undersample(events(spark, d), F.col("y"), 1000, "event_id").select("event_id", "y")


@query
def q_hash_split(spark, d):
    return L.hash_split(events(spark, d), "event_id", 0.2).groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def q_recombined_test(spark, d):
    train, test = L.held_out_normals_with_anomalies(events(spark, d).select("event_id", "ts", "y"), F.col("y"), "ts", "event_id", 2000)
    named = [x.groupBy("y").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("side", F.lit(n)) for x, n in ((train, "train"), (test, "test"))]
    return named[0].unionByName(named[1])


@query
def q_topk_amount(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read_parquet(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("o_custkey", "rank", "o_orderkey", "o_totalprice")


@query
def q_amount_deviation(spark, d):
    return rounded(B.amount_deviation(events(spark, d), "user_id", "ts", "event_id", "value"), "amount_deviation").select("event_id", "amount_deviation")


@query
def q_normal_range(spark, d):
    return rounded(B.normal_range(events(spark, d), "user_id", "ts", "event_id", "value"), "low", "high").select("event_id", "low", "high", "out_of_range")


@query
def q_velocity(spark, d):
    return B.velocity(events(spark, d), "user_id", "ts", 86_400).select("event_id", "velocity")


def _purchases(spark, d):
    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    lines = read_parquet(spark, d, "lineitem").withColumn("r", F.row_number().over(first)).filter("r = 1").select("l_orderkey", "l_suppkey")
    return read_parquet(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


@query
def q_merchant_frequency(spark, d):
    rows = _purchases(spark, d).withColumn("merchant", F.col("l_suppkey") % 10)
    return rounded(B.partner_frequency(rows, "o_custkey", "merchant", "o_orderdate", "o_orderkey"), "partner_frequency").select("o_orderkey", "partner_frequency")


@query
def q_geo_deviation(spark, d):
    o, c, n, s = (read_parquet(spark, d, t) for t in ("orders", "customer", "nation", "supplier"))
    r = read_parquet(spark, d, "region")
    places = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    rows = _purchases(spark, d).join(places, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(B.place_deviation(rows, "o_custkey", "r_name", "o_orderdate", "o_orderkey"), "place_deviation").select("o_orderkey", "r_name", "place_deviation")


@query
def q_temporal_deviation(spark, d):
    return B.hour_deviation(events(spark, d), "user_id", "ts", "event_id").select("event_id", F.round("hour_deviation", 4).alias("hour_deviation"))


@query
def q_timeline(spark, d):
    return rounded(B.timeline(events(spark, d), "user_id", "ts", "event_id", "value"), "seconds_since", "change", "recent_mean").select("event_id", "seconds_since", "change", "recent_mean")


@query
def q_attention_rank(spark, d):
    return B.attention_rank(events(spark, d).select("event_id", "value"), "value").select("event_id", "attention_rank", "tier")


@query
def q_asof_profile(spark, d):
    e = events(spark, d)
    errors, bought = e.filter("y = 1").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return B.as_of(errors, bought, "user_id", "ts", ["value"]).select("event_id", "asof_value")


@query
def q_baseline(spark, d):
    rows = B.baseline(events(spark, d), "user_id", "value", F.col("event_type"), F.hour("ts"))
    return rounded(rows, "low", "high", "mean_hour")


@query
def q_reference_window(spark, d):
    return B.reference_window(events(spark, d), "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00").groupBy("user_id").agg(F.count("*").alias("n"))


@query
def q_leakage_disjoint(spark, d):
    s = _split(spark, d)
    return L.overlap(s.train, s.test, "event_id").agg(F.count("*").alias("n_shared"))


@query
def q_session_activity(spark, d):
    return B.sessions(events(spark, d), "user_id", "ts", 1800)


def _predicted(spark, d):
    return events(spark, d).withColumn("p", (F.col("value") > 50).cast("int"))


@query
def q_confusion(spark, d):
    return rounded(M.rates(_predicted(spark, d), "y", "p"), "accuracy", "sensitivity", "specificity", "fpr", "fnr")


@query
def q_class_report(spark, d):
    return rounded(M.class_report(_predicted(spark, d), "y", "p"), "precision", "recall", "f1")


@query
def q_roc_auc(spark, d):
    return rounded(M.roc_auc(events(spark, d), "value", "y"), "roc_auc")


@query
def q_average_precision(spark, d):
    return rounded(M.average_precision(events(spark, d), "value", "y"), "average_precision")


@query
def q_precision_at_k(spark, d):
    return rounded(M.precision_at(events(spark, d), "value", "y", "event_id", [10, 100, 500]), "precision")


@query
def q_threshold_curve(spark, d):
    return M.threshold_curve(events(spark, d).withColumn("s", F.floor("value")), "s", "y").select("threshold", "tp", "fp")


@query
def q_calibration(spark, d):
    return rounded(M.calibration(events(spark, d).withColumn("s", F.col("value") / 500), "s", "y"), "mean_score", "positive_rate")


@query
def q_by_period(spark, d):
    rows = M.by_period(_predicted(spark, d), "ts", "day", "y", "p")
    return rounded(rows.withColumn("period", F.col("period").cast("date")), "recall", "precision")


@query
def q_drift_psi(spark, d):
    return rounded(Q.population_stability(events(spark, d), "value", F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), "psi")


@query
def q_paired_disagreement(spark, d):
    e = events(spark, d).select("event_id", "y", "value")
    a, b = (e.select("event_id", "y", (F.col("value") > t).cast("int").alias("p")) for t in (50, 100))
    return M.disagreement(a, b, "event_id", "y", "p")


@query
def q_error_analysis(spark, d):
    return M.outcomes(_predicted(spark, d), "y", "p", "value", 50.0, 5.0).groupBy("outcome", "borderline").agg(F.count("*").alias("n"))


def _vectors(spark, d):
    return read_parquet(spark, d, "embeddings")


@query
def q_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return rounded(N.cosine_top(v.filter("vec_id % 50 = 0"), v, "vec_id", "embedding", 5), "similarity").select("query_id", "rank", "id", "similarity")


@query
def q_rbf_gram(spark, d):
    return N.rbf_gram(_vectors(spark, d), "vec_id", "embedding", 0.5, decimals=6)


@query
def q_knn(spark, d):
    return rounded(N.nearest(_vectors(spark, d), "vec_id", "embedding", 10), "distance")


@query
def q_lof(spark, d):
    return rounded(N.local_outlier_factor(_vectors(spark, d), "vec_id", "embedding", 10), "lof")


@query
def q_dbscan_noise(spark, d):
    return N.density_noise(_vectors(spark, d), "vec_id", "embedding", 1.2, 5)


@query
def q_zscore(spark, d):
    rows = D.zscore(read_parquet(spark, d, "orders"), "o_totalprice")
    return rows.select("o_orderkey", r6("z").alias("z"))


@query
def q_robust_flags(spark, d):
    return rounded(D.robust_flags(events(spark, d), "value"), "mad_z").select("event_id", "outside", "mad_z")


@query
def q_mahalanobis(spark, d):
    rows = D.mahalanobis(read_parquet(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("total"), F.round(F.max("distance"), 4).alias("furthest"))


@query
def q_elliptic_envelope(spark, d):
    rows = vector_columns(_vectors(spark, d), "embedding", 4)
    return D.flagged(D.elliptic_envelope(rows, "vec_id", ["V1", "V2", "V3", "V4"]), "distance", 0.1).select("vec_id", "distance", "prediction")


@query
def q_isolation_forest(spark, d):
    return D.flagged(D.isolation_forest(_vectors(spark, d), "vec_id", "embedding"), "score", 0.05).select("vec_id", "score", "prediction")


@query
def q_ocsvm(spark, d):
    return D.one_class_svm(_vectors(spark, d), "vec_id", "embedding", gamma=0.5, nu=0.05).select("vec_id", "score", (F.col("score") > 0).cast("int").alias("prediction"))


@query
def q_pca_recon(spark, d):
    return D.flagged(D.pca_reconstruction(_vectors(spark, d), "vec_id", "embedding", components=8), "error", 0.1).select("vec_id", "error", "prediction")


@query
def q_som(spark, d):
    return D.self_organizing_map(_vectors(spark, d), "vec_id", "embedding").select("vec_id", "winner", "quantization_error", "cell_distance")


@query
def q_pca(spark, d):
    rows, _ = X.vector_pca(_vectors(spark, d), "embedding", 3)
    return rows.select("vec_id", "pc1", "pc2", "pc3")


def _labelled(spark, d):
    return vector_columns(_vectors(spark, d), "embedding", 64).withColumn("y", (F.col("label") == 0).cast("int")).select("vec_id", "y", *[f"V{i}" for i in range(1, 65)])


@query
def q_logistic(spark, d):
    rows = L.hash_split(_labelled(spark, d), "vec_id", 0.25)
    cols = [f"V{i}" for i in range(1, 65)]
    return D.supervised(rows.filter("split = 'train'"), rows.filter("split = 'test'"), cols, "y").select("vec_id", "y", "probability")


@query
def q_gbt(spark, d):
    rows = L.hash_split(_labelled(spark, d), "vec_id", 0.25)
    cols = [f"V{i}" for i in range(1, 65)]
    return D.supervised(rows.filter("split = 'train'"), rows.filter("split = 'test'"), cols, "y", "boosted", maxIter=5, seed=1).select("vec_id", "y", "probability")


def _pairs(spark, d):
    return _vectors(spark, d).select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("x"))


@query
def q_zz_kernel(spark, d):
    v = _pairs(spark, d)
    return K.zz_kernel(v, v.filter("vec_id % 50 = 0"), "vec_id", "x").select("id", "anchor", r6("k").alias("k"), "backend", "qubits")


@query
def q_quantum_ocsvm(spark, d):
    return K.kernel_one_class(_pairs(spark, d), "vec_id", "x").select("vec_id", "score")


def _scored(spark, d):
    return B.amount_deviation(events(spark, d), "user_id", "ts", "event_id", "value", "score")


@query
def q_anomaly_level(spark, d):
    return A.distribution(A.assessed(_scored(spark, d), "score", LEVELS), "level", "policy_version")


@query
def q_risk_policy(spark, d):
    rows = A.assessed(_scored(spark, d).filter("score IS NOT NULL"), "score", RISK)
    acts = {"NORMAL": ("closed", "none"), "ATTENTION": ("open", "review"), "HIGH_RISK": ("open", "contact")}
    return A.distribution(A.decisions(rows, "level", acts), "level", "state", "recommended_action")


@query
def q_evidence(spark, d):
    rows = A.evidence(read_parquet(spark, d, "orders").withColumn("month", F.month("o_orderdate").cast("double")), "o_orderkey", ["o_totalprice", "month"], 1)
    return rounded(rows, "value", "deviation")


@query
def q_cases(spark, d):
    return rounded(A.cases(A.assessed(_scored(spark, d), "score", LEVELS), "user_id", "score", "level", ["MEDIUM", "HIGH"]), "priority")


@query
def q_case_members(spark, d):
    return A.case_members(A.assessed(_scored(spark, d), "score", LEVELS), "user_id", "event_id", "level", ["MEDIUM", "HIGH"])


@query
def q_row_range(spark, d):
    return L.row_range(events(spark, d).select("event_id", "user_id", "ts", "value"), "ts", "event_id", 100, 250)


@query
def q_rows_at(spark, d):
    orders = read_parquet(spark, d, "orders")
    wanted = read_parquet(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.rows_at(orders, wanted, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query
def q_evidence_rows(spark, d):
    rows = read_parquet(spark, d, "orders").withColumn("month", F.month("o_orderdate").cast("double"))
    return rounded(A.expanded(rows, "o_orderkey", ["o_totalprice", "month"], least=1.5), "value", "deviation")


@query
def q_nth_values(spark, d):
    rows = B.frame_values(events(spark, d), "user_id", "ts", "event_id", "value")
    return rounded(rows, "second", "around", "without_self").select("event_id", "second", "around", "without_self")


@query
def q_latent_classifier(spark, d):
    rows = L.hash_split(_vectors(spark, d).withColumn("y", (F.col("label") == 0).cast("int")), "vec_id", 0.25)
    return D.latent_classifier(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "vec_id", "embedding", "y").select("vec_id", "y", "probability")


@query
def q_kernel_svm(spark, d):
    rows = L.hash_split(_pairs(spark, d).join(_vectors(spark, d).select("vec_id", (F.col("label") == 0).cast("int").alias("y")), "vec_id"), "vec_id", 0.25)
    return K.kernel_svm(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "vec_id", "x", "y").select("vec_id", "y", "score")


@query
def q_routing(spark, d):
    return A.distribution(A.routed(_scored(spark, d).filter("score IS NOT NULL"), "score", 1.0, 2.0), "route")


@query
def q_fallback(spark, d):
    s = _scored(spark, d).filter("score IS NOT NULL")
    return A.combined(s, s.filter("event_type = 'error'").withColumn("score", F.col("score") * 2), "event_id", "score").select("event_id", r6("score").alias("score"), "method")


@query
def q_overview(spark, d):
    rows = A.assessed(_scored(spark, d), "score", LEVELS)
    w = Window.orderBy(F.col("ts").desc(), "event_id")
    alerts = rows.filter("level = 'HIGH'").orderBy(F.col("ts").desc(), "event_id").limit(10)
    return alerts.withColumn("rank", F.row_number().over(w)).select("rank", "event_id", "user_id", "ts", r6("score").alias("score"))


@query
def q_transaction_summary(spark, d):
    o, c, n = (read_parquet(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", "o_totalprice", "o_orderdate", "c_name", F.col("n_name").alias("place"))


def _orders_by_place(spark, d):
    o, c, n, r = (read_parquet(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("o_orderstatus").alias("status"), "o_totalprice", "o_custkey")


@query
def q_rollup_risk(spark, d):
    return _orders_by_place(spark, d).rollup("region", "nation").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"))


@query
def q_cube_region(spark, d):
    return _orders_by_place(spark, d).cube("region", "status").agg(F.count("*").alias("n"))


@query
def q_set_operations(spark, d):
    e = events(spark, d)
    errors, buyers = e.filter("y = 1").select("user_id"), e.filter("event_type = 'purchase' AND value > 100").select("user_id")
    parts = {"union": errors.union(buyers).distinct(), "intersect": errors.intersect(buyers), "except": errors.subtract(buyers), "union_all": errors.unionByName(buyers)}
    out = [x.agg(F.count("*").alias("n")).withColumn("op", F.lit(k)) for k, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def q_window_velocity(spark, d):
    rows = W.window_velocity(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 day")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query
def q_interval_join(spark, d):
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = W.within_interval(e.filter("y = 1"), e.filter("event_type = 'purchase'"), "user_id", "ts", 3600)
    return rows.select("a_id", "b_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)
