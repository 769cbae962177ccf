"""The catalogue's queries in plain SQL, written on their own for another engine."""

from __future__ import annotations

EV = "e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::INTEGER AS y FROM events)"
PAST = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SPLIT = f"""{EV}, n AS (SELECT count(*) AS n FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, event_id) - 1 AS rn FROM e),
s AS (SELECT r.*, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r, n)"""
SCORED = f"""{EV}, d AS (SELECT *, CASE WHEN stddev_samp(value) OVER {PAST} <> 0 THEN (value - avg(value) OVER {PAST}) / stddev_samp(value) OVER {PAST} END AS score FROM e),
lv AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score >= 3 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'NORMAL' END AS level FROM d)"""
SKEW = "skewness({0})"
SLOG = "sign({0}) * ln(1 + abs({0}))"
CURVE = """c AS (SELECT v AS threshold, sum(y)::BIGINT AS p, count(*) AS n FROM x GROUP BY v),
k AS (SELECT *, (sum(p) OVER w)::BIGINT AS tp, (sum(n - p) OVER w)::BIGINT AS fp FROM c WINDOW w AS (ORDER BY threshold DESC))"""
CELLS = """c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn
FROM (SELECT y, CASE WHEN value > 50 THEN 1 ELSE 0 END AS p FROM e))"""
PURCHASES = """l AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem),
b AS (SELECT orders.*, l_suppkey FROM orders JOIN l ON o_orderkey = l_orderkey AND r = 1)"""
PLACES = "p AS (SELECT r_name AS region, n_name AS nation, o_orderstatus AS status, o_totalprice, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
DIST = "sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))"
VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
NEAR = f"""{VEC}, pr AS (SELECT a.id, b.id AS other, {DIST} AS distance FROM v a, v b WHERE a.id <> b.id),
nn AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY distance, other))::INTEGER AS rank FROM pr QUALIFY rank <= 10)"""
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

ORACLES = {
    "q_temporal_split_counts": f"WITH {SPLIT} SELECT split, count(*) AS n, sum(y)::BIGINT AS positives FROM s GROUP BY split",
    "q_temporal_split_bounds": f"WITH {SPLIT} SELECT split, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY split",
    "q_train_fit_scale": f"""WITH {SPLIT}, f AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM s WHERE split = 'train'),
z AS (SELECT split, y, (value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM s, f)
SELECT split, count(*) AS n, sum(y)::BIGINT AS positives, round(sum(z), 6) + 0.0 AS sum_z, round(sum(z * z), 6) AS sum_z2 FROM z GROUP BY split""",
    "q_quality_report": f"""WITH {EV} SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids, count(*) FILTER (ts IS NULL) AS missing_ts,
count(*) FILTER (value IS NULL OR isnan(value)) AS missing_value, count(*) FILTER (event_type IS NULL) AS missing_event_type, min(y) AS min_label, max(y) AS max_label FROM e""",
    "q_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "q_quarantine": """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 100 THEN NULL ELSE 'price_over_100' END,
CASE WHEN o_orderstatus IN ('O', 'F') THEN NULL ELSE 'status_known' END, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN NULL ELSE 'dated_from_1996' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM orders WHERE NOT coalesce(o_totalprice > 100 AND o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1996-01-01', false)""",
    "q_out_of_order": "SELECT user_id, coalesce(sum(late), 0)::BIGINT AS n_late FROM (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS late FROM events) GROUP BY user_id",
    "q_class_balance": f"""WITH {EV}, c AS (SELECT y AS label, count(*) AS n FROM e GROUP BY y)
SELECT label, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 6) AS percent, round((SELECT count(*) FROM e WHERE y = 1)::DOUBLE / (SELECT count(*) FROM e WHERE y = 0), 6) AS contamination FROM c""",
    "q_skewness_profile": " UNION ALL ".join(f"SELECT '{c}' AS feature, round({SKEW.format(c)}, 6) AS before, round({SKEW.format(SLOG.format(c))}, 6) AS after FROM lineitem" for c in LINE),
    "q_describe": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(stddev_pop({c}), 6) AS std_population, round(min({c}), 6) AS min, round(median({c}), 6) AS median, round(max({c}), 6) AS max FROM lineitem" for c in LINE[:2]),
    "q_signed_log": f"SELECT event_id, round(CASE WHEN abs((SELECT skewness(value) FROM events)) > 0.75 THEN {SLOG.format('value')} ELSE value END, 6) AS value FROM events",
    "q_histogram_30": "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(29, floor((value - lo) / (hi - lo) * 30))::INTEGER AS bin, count(*) AS n FROM events, m GROUP BY 1",
    "q_percentile_threshold": "WITH t AS (SELECT quantile_cont(value, 0.9) AS t FROM events) SELECT round(max(t), 6) AS threshold, count(*) FILTER (value > t) AS n_over FROM events, t",
    "q_median_impute": """WITH d AS (SELECT quality::DOUBLE AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT coalesce(q, (SELECT median(q) FROM d)) AS quality, count(*) AS n FROM d GROUP BY 1""",
    "q_fixed_bins": "SELECT CASE WHEN l_quantity <= 7.91 THEN 0 WHEN l_quantity <= 14.454 THEN 1 WHEN l_quantity <= 31 THEN 2 ELSE 3 END::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "q_quantile_bins": """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)
SELECT ((l_extendedprice > a)::INTEGER + (l_extendedprice > b)::INTEGER + (l_extendedprice > c)::INTEGER)::INTEGER AS bin, count(*) AS n FROM lineitem, q GROUP BY 1""",
    "q_equal_width_bins": """WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT least(4, greatest(0, ceil((l_quantity - lo) / (hi - lo) * 5) - 1))::INTEGER AS bin, count(*) AS n FROM lineitem, m GROUP BY 1""",
    "q_minmax_scale": "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice FROM orders",
    "q_minmax_inverse": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders",
    "q_hour_of_day": """SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS band,
(dayofweek(ts) + 1)::INTEGER AS weekday, count(*) AS n FROM events GROUP BY 1, 2""",
    "q_value_mapping": """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'low' ELSE o_orderpriority END AS urgency,
CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END::INTEGER AS status_code, (o_totalprice > 1000)::INTEGER AS is_large, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
    "q_regex_extract": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, length(url)::INTEGER AS n_url, (html IS NOT NULL)::INTEGER AS has_html FROM pages",
    "q_json_props": "SELECT (props::JSON ->> 'k')::INTEGER AS k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
    "q_undersample_hash": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || event_id), event_id) AS r FROM e) SELECT event_id, y FROM r WHERE y = 1 OR r <= 1000""",
    "q_hash_split": "SELECT CASE WHEN ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT < floor(0.2::DOUBLE * 4294967296) THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
    "q_recombined_test": f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ts, event_id) AS r FROM e)
SELECT y, count(*) AS n, sum(event_id)::BIGINT AS ids, CASE WHEN y = 0 AND r <= 2000 THEN 'train' ELSE 'test' END AS side FROM r GROUP BY 1, 4""",
    "q_topk_amount": "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rank, o_orderkey, o_totalprice FROM orders QUALIFY rank <= 5",
    "q_amount_deviation": f"WITH {SCORED} SELECT event_id, round(score, 6) AS amount_deviation FROM d",
    "q_normal_range": f"""WITH q AS (SELECT event_id, value, quantile_cont(value, 0.05) OVER {PAST} AS low, quantile_cont(value, 0.95) OVER {PAST} AS high FROM events)
SELECT event_id, round(low, 6) AS low, round(high, 6) AS high, coalesce(value < low OR value > high, false)::INTEGER AS out_of_range FROM q""",
    "q_velocity": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS velocity FROM events",
    "q_merchant_frequency": f"""WITH {PURCHASES}, k AS (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, l_suppkey % 10 ORDER BY o_orderdate, o_orderkey) - 1 AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM b)
SELECT o_orderkey, CASE WHEN n > 0 THEN round(a::DOUBLE / n, 6) END AS partner_frequency FROM k""",
    "q_geo_deviation": f"""WITH {PURCHASES}, g AS (SELECT b.*, r_name FROM b JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN customer ON o_custkey = c_custkey),
k AS (SELECT o_orderkey, r_name, count(*) OVER (PARTITION BY o_custkey, r_name ORDER BY o_orderdate, o_orderkey) - 1 AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM g)
SELECT o_orderkey, r_name, CASE WHEN n > 0 THEN round(1 - a::DOUBLE / n, 6) END AS place_deviation FROM k""",
    "q_temporal_deviation": f"""WITH h AS (SELECT event_id, user_id, ts, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events),
m AS (SELECT event_id, h, atan2(avg(sin(h * pi() / 12)) OVER {PAST}, avg(cos(h * pi() / 12)) OVER {PAST}) * 12 / pi() AS a FROM h),
k AS (SELECT event_id, abs(h - CASE WHEN a < 0 THEN a + 24 ELSE a END) AS d FROM m)
SELECT event_id, CASE WHEN d IS NOT NULL THEN round(least(d, 24 - d), 4) END AS hour_deviation FROM k""",
    "q_timeline": """SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE, 6) AS seconds_since, round(value - lag(value) OVER w, 6) AS change,
round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS recent_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "q_attention_rank": """WITH r AS (SELECT event_id, rank() OVER (ORDER BY value DESC NULLS LAST) AS a, count(*) OVER () AS n FROM events)
SELECT event_id, a AS attention_rank, (floor((a - 1) * 4 / n) + 1)::INTEGER AS tier FROM r""",
    "q_asof_profile": """SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
    "q_baseline": """WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), u AS (SELECT user_id, event_type AS usual_place FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_type DESC) = 1)
SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.95), 6) AS high, round(avg(hour(ts)), 6) AS mean_hour, max(usual_place) AS usual_place FROM events JOIN u USING (user_id) GROUP BY user_id""",
    "q_reference_window": "SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY user_id",
    "q_leakage_disjoint": f"WITH {SPLIT} SELECT count(*) AS n_shared FROM (SELECT event_id FROM s WHERE split = 'train' INTERSECT SELECT event_id FROM s WHERE split = 'test')",
    "q_session_activity": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "q_confusion": f"""WITH {EV}, {CELLS} SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, fp + fn AS n_errors, round(tp::DOUBLE / (tp + fn), 6) AS sensitivity,
round(tn::DOUBLE / (tn + fp), 6) AS specificity, round(fp::DOUBLE / (fp + tn), 6) AS fpr, round(fn::DOUBLE / (fn + tp), 6) AS fnr FROM c""",
    "q_class_report": f"""WITH {EV}, {CELLS}, o AS (SELECT '0' AS class, tn AS t, fn AS p, fp AS n FROM c UNION ALL SELECT '1', tp, fp, fn FROM c),
r AS (SELECT class, coalesce(t::DOUBLE / nullif(t + p, 0), 0) AS precision, coalesce(t::DOUBLE / nullif(t + n, 0), 0) AS recall, t + n AS support FROM o),
f AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM r),
a AS (SELECT * FROM f UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a""",
    "q_roc_auc": f"""WITH {EV}, r AS (SELECT y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS mr FROM e)
SELECT round((sum(mr) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r""",
    "q_average_precision": f"WITH {EV}, x AS (SELECT value AS v, y FROM e), {CURVE} SELECT round(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS average_precision FROM k",
    "q_precision_at_k": f"""WITH {EV}, r AS (SELECT y, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM e), ks AS (SELECT unnest([10, 100, 500])::INTEGER AS k)
SELECT k, round(avg(y), 6) AS precision FROM ks JOIN r ON r <= k GROUP BY k""",
    "q_threshold_curve": f"WITH {EV}, x AS (SELECT floor(value)::BIGINT AS v, y FROM e), {CURVE} SELECT threshold, tp, fp FROM k",
    "q_calibration": f"WITH {EV} SELECT least(9, floor(value / 500 * 10))::INTEGER AS bin, count(*) AS n, round(avg(value / 500), 6) AS mean_score, round(avg(y), 6) AS positive_rate FROM e GROUP BY 1",
    "q_by_period": f"""WITH {EV} SELECT ts::DATE AS period, count(*) AS n, round(count(*) FILTER (y = 1 AND value > 50)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 6) AS recall,
round(count(*) FILTER (y = 1 AND value > 50)::DOUBLE / nullif(count(*) FILTER (value > 50), 0), 6) AS precision FROM e GROUP BY 1""",
    "q_drift_psi": """WITH x AS (SELECT value, ts < TIMESTAMP '2024-01-20' AS r FROM events), m AS (SELECT min(value) AS lo, max(value) AS hi FROM x WHERE r),
b AS (SELECT greatest(0, least(9, floor((value - lo) / (hi - lo) * 10)))::INTEGER AS b, r FROM x, m),
c AS (SELECT g.b, 1 + count(*) FILTER (r) AS a, 1 + count(*) FILTER (NOT r) AS d FROM (SELECT unnest(range(10))::INTEGER AS b) g LEFT JOIN b ON b.b = g.b GROUP BY g.b),
q AS (SELECT a::DOUBLE / sum(a) OVER () AS p, d::DOUBLE / sum(d) OVER () AS q FROM c) SELECT round(sum((p - q) * ln(p / q)), 6) AS psi FROM q""",
    "q_paired_disagreement": f"""WITH {EV}, r AS (SELECT (value > 50)::INTEGER = y AS a, (value > 100)::INTEGER = y AS b FROM e)
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM r""",
    "q_error_analysis": f"""WITH {EV} SELECT CASE WHEN y = 1 AND value > 50 THEN 'tp' WHEN value > 50 THEN 'fp' WHEN y = 1 THEN 'fn' ELSE 'tn' END AS outcome, (abs(value - 50) <= 5)::INTEGER AS borderline, count(*) AS n FROM e GROUP BY 1, 2""",
    "q_cosine_topk": f"""WITH {VEC}, c AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.v, b.v) AS s FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id))::INTEGER AS rank, id, round(s, 6) AS similarity FROM c QUALIFY rank <= 5""",
    "q_rbf_gram": f"WITH {VEC} SELECT a.id AS i, b.id AS j, round(exp(-0.5::DOUBLE * pow({DIST}, 2)), 6) AS k FROM v a, v b WHERE a.id <= b.id",
    "q_knn": f"WITH {NEAR} SELECT id, other, round(distance, 6) AS distance, rank FROM nn",
    "q_lof": f"""WITH {NEAR}, kd AS (SELECT id, max(distance) AS kd FROM nn GROUP BY id),
l AS (SELECT nn.id, count(*) / sum(greatest(distance, kd.kd)) AS lrd FROM nn JOIN kd ON kd.id = other GROUP BY nn.id)
SELECT nn.id, round(avg(o.lrd) / max(s.lrd), 6) AS lof FROM nn JOIN l o ON o.id = other JOIN l s ON s.id = nn.id GROUP BY nn.id""",
    "q_dbscan_noise": f"""WITH {VEC}, pr AS (SELECT a.id, b.id AS other FROM v a, v b WHERE {DIST} <= 1.2), c AS (SELECT id, count(*) AS n_near FROM pr GROUP BY id),
t AS (SELECT DISTINCT pr.id FROM pr JOIN c ON c.id = pr.other WHERE c.n_near >= 5 AND pr.id <> pr.other)
SELECT c.id, n_near, (n_near >= 5)::INTEGER AS is_core, (n_near < 5 AND t.id IS NULL)::INTEGER AS is_noise FROM c LEFT JOIN t ON t.id = c.id""",
    "q_zscore": "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders",
    "q_robust_flags": """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events), m AS (SELECT median(abs(value - b)) AS d FROM events, q)
SELECT event_id, (value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a))::INTEGER AS outside, round(0.6745::DOUBLE * (value - b) / d, 6) AS mad_z FROM events, q, m""",
    "q_mahalanobis": """WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS xx, var_pop(l_extendedprice) AS yy, covar_pop(l_quantity, l_extendedprice) AS xy FROM lineitem),
d AS (SELECT l_returnflag, (yy * pow(l_quantity - mx, 2) - 2 * xy * (l_quantity - mx) * (l_extendedprice - my) + xx * pow(l_extendedprice - my, 2)) / (xx * yy - xy * xy) AS d FROM lineitem, s)
SELECT l_returnflag, count(*) AS n, round(sum(d), 4) AS total, round(max(d), 4) AS furthest FROM d GROUP BY 1""",
    "q_anomaly_level": f"WITH {SCORED} SELECT level, '2024-1' AS policy_version, count(*) AS n FROM lv GROUP BY 1, 2",
    "q_risk_policy": f"""WITH {SCORED}, r AS (SELECT CASE WHEN score >= 4 THEN 'HIGH_RISK' WHEN score >= 2 THEN 'ATTENTION' ELSE 'NORMAL' END AS level FROM d WHERE score IS NOT NULL)
SELECT level, CASE level WHEN 'NORMAL' THEN 'closed' ELSE 'open' END AS state, CASE level WHEN 'NORMAL' THEN 'none' WHEN 'ATTENTION' THEN 'review' ELSE 'contact' END AS recommended_action, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "q_evidence": """WITH o AS (SELECT o_orderkey, o_totalprice, month(o_orderdate)::DOUBLE AS m FROM orders),
z AS (SELECT *, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS a, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS b FROM o)
SELECT o_orderkey, 1::INTEGER AS rank, 'transaction' AS type, CASE WHEN abs(a) >= abs(b) THEN 'o_totalprice' ELSE 'month' END AS feature, round(CASE WHEN abs(a) >= abs(b) THEN o_totalprice ELSE m END, 6) AS value,
round(CASE WHEN abs(a) >= abs(b) THEN a ELSE b END, 6) AS deviation, CASE WHEN abs(a) >= abs(b) THEN 'o_totalprice' ELSE 'month' END || ' is ' || CASE WHEN CASE WHEN abs(a) >= abs(b) THEN a ELSE b END >= 0 THEN 'above' ELSE 'below' END || ' its mean' AS explanation FROM z""",
    "q_cases": f"""WITH {SCORED} SELECT user_id, count(*) AS n, round(max(score), 6) AS priority FROM lv WHERE level IN ('MEDIUM', 'HIGH') GROUP BY user_id""",
    "q_case_members": f"WITH {SCORED} SELECT user_id, event_id AS id FROM lv WHERE level IN ('MEDIUM', 'HIGH')",
    "q_row_range": "SELECT event_id, user_id, ts, value FROM events QUALIFY row_number() OVER (ORDER BY ts NULLS LAST, event_id) - 1 BETWEEN 100 AND 250",
    "q_rows_at": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
    "q_evidence_rows": """WITH o AS (SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice, month(o_orderdate)::DOUBLE AS month FROM orders), f AS (SELECT avg(o_totalprice) AS pm, stddev_samp(o_totalprice) AS ps, avg(month) AS mm, stddev_samp(month) AS ms FROM o),
l AS (SELECT o_orderkey, 'o_totalprice' AS feature, o_totalprice AS value, (o_totalprice - pm) / ps AS deviation FROM o, f UNION ALL SELECT o_orderkey, 'month', month, (month - mm) / ms FROM o, f)
SELECT o_orderkey, feature, round(value, 6) AS value, round(deviation, 6) AS deviation FROM l WHERE abs(deviation) >= 1.5""",
    "q_nth_values": """SELECT event_id, round(nth_value(value, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS second,
round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 6) AS without_self
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "q_zz_kernel": """WITH x AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
p AS (SELECT id, 2 * a + 2 * (pi() - a) * (pi() - b) AS p1, 2 * b + 2 * (pi() - a) * (pi() - b) AS p2, 2 * a + 2 * b AS p3 FROM x),
c AS (SELECT *, cos(p1) AS c1, sin(p1) AS s1, cos(p2) AS c2, sin(p2) AS s2, cos(p3) AS c3, sin(p3) AS s3 FROM p),
h AS (SELECT *, (1 + c1 + c2 + c3) / 4 AS r0, (s1 + s2 + s3) / 4 AS i0, (1 - c1 + c2 - c3) / 4 AS u1, (-s1 + s2 - s3) / 4 AS v1,
(1 + c1 - c2 - c3) / 4 AS u2, (s1 - s2 - s3) / 4 AS v2, (1 - c1 - c2 + c3) / 4 AS u3, (-s1 - s2 + s3) / 4 AS v3 FROM c),
q AS (SELECT id, [r0, u1 * c1 - v1 * s1, u2 * c2 - v2 * s2, u3 * c3 - v3 * s3] AS re, [i0, u1 * s1 + v1 * c1, u2 * s2 + v2 * c2, u3 * s3 + v3 * c3] AS im FROM h)
SELECT q.id, g.id AS anchor, round(pow(list_inner_product(g.re, q.re) + list_inner_product(g.im, q.im), 2) + pow(list_inner_product(g.re, q.im) - list_inner_product(g.im, q.re), 2), 6) AS k,
'ideal statevector simulation' AS backend, '2' AS qubits FROM q, q g WHERE g.id % 50 = 0""",
    "q_routing": f"WITH {SCORED} SELECT CASE WHEN score BETWEEN 1 AND 2 THEN 'second' ELSE 'first' END AS route, count(*) AS n FROM d WHERE score IS NOT NULL GROUP BY 1",
    "q_fallback": f"WITH {SCORED} SELECT event_id, round(CASE WHEN y = 1 THEN score * 2 ELSE score END, 6) AS score, CASE WHEN y = 1 THEN 'other' ELSE 'classical' END AS method FROM d WHERE score IS NOT NULL",
    "q_overview": f"WITH {SCORED}, t AS (SELECT (row_number() OVER (ORDER BY ts DESC, event_id))::INTEGER AS rank, event_id, user_id, ts, round(score, 6) AS score FROM lv WHERE level = 'HIGH') SELECT * FROM t WHERE rank <= 10",
    "q_transaction_summary": "SELECT o_orderkey, o_totalprice, o_orderdate, c_name, n_name AS place FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "q_rollup_risk": f"WITH {PLACES} SELECT region, nation, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM p GROUP BY ROLLUP (region, nation)",
    "q_cube_region": f"WITH {PLACES} SELECT region, status, count(*) AS n FROM p GROUP BY CUBE (region, status)",
    "q_set_operations": f"""WITH {EV}, a AS (SELECT user_id FROM e WHERE y = 1), b AS (SELECT user_id FROM e WHERE event_type = 'purchase' AND value > 100)
SELECT count(*) AS n, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT count(*), 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT count(*), 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT count(*), 'union_all' FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "q_window_velocity": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1, 2",
    "q_interval_join": """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'error' AND b.event_type = 'purchase'""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
