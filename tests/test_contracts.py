import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normcast.operators import splitting as L
from normcast.operators.ordered import kth_smallest, percentiles, running_totals
from normcast.operators.quality import ContractError, check_contract, cleaned, conforms, quarantine
from normcast.operators.transforms import build_features, feature_columns, impute_random, minmax_scale, passenger_features, standard_scale
from normcast.sources import tables as T

NEED = ("Time", "Amount", "Class")


@pytest.fixture(scope="module")
def frame(spark):
    return T.synthetic_transactions(spark, 1000).cache()


def test_contract_passes_and_fails_in_order(spark, frame):
    check_contract(frame, NEED, "Class")
    check_contract(frame.limit(0), NEED, "Class")
    with pytest.raises(ContractError, match="missing columns: Class"):
        check_contract(frame.drop("Class"), NEED, "Class")
    for bad in (float("nan"), None):
        with pytest.raises(ContractError, match="null values in: Amount"):
            check_contract(frame.withColumn("Amount", F.when(F.col("Time") != 0, F.col("Amount")).otherwise(F.lit(bad).cast("double"))), NEED, "Class")
    with pytest.raises(ContractError, match="0 or 1"):
        check_contract(frame.withColumn("Class", F.when(F.col("Time") == 0, 2).otherwise(F.col("Class"))), NEED, "Class")


def test_label_kinds(frame):
    for kind in ("double", "boolean", "bigint"):
        check_contract(frame.withColumn("Class", F.col("Class").cast(kind)), NEED, "Class")
    with pytest.raises(ContractError):
        check_contract(frame.withColumn("Class", F.col("Class").cast("string")), NEED, "Class")
    with pytest.raises(ContractError):
        check_contract(frame.withColumnRenamed("Class", "class"), NEED, "Class")


def test_split_sizes_order_and_metadata(frame):
    s = L.temporal_split(frame, "Time", "Time")
    assert (s.metadata["n_train"], s.metadata["n_validation"], s.metadata["n_test"]) == (700, 150, 150)
    assert s.metadata["test_ratio"] == 0.15
    assert [x.count() for x in (s.train, s.validation, s.test)] == [700, 150, 150]
    b = {r["split"]: r for r in L.bounds(s.rows, "Time").collect()}
    assert b["train"]["last"] < b["validation"]["first"] and b["validation"]["last"] < b["test"]["first"]


@pytest.mark.parametrize("n,want", [(0, (0, 0)), (1, (0, 0)), (2, (1, 1)), (3, (2, 2)), (6, (4, 5)), (7, (4, 5)), (1000, (700, 850)), (284807, (199364, 242085))])
def test_cut_points(n, want):
    assert L.cut_points(n, 0.7, 0.15) == want
    assert L.cut_points(n, 0.7, 0.15) == (int(n * 0.7), int(n * (0.7 + 0.15)))


def test_split_guards(frame):
    for a, b in ((0.9, 0.2), (0.7, 0.3), (0.8, 0.2), (-0.1, 0.5)):
        with pytest.raises(ContractError):
            L.temporal_split(frame, "Time", "Time", a, b)
    with pytest.raises(ContractError):
        L.temporal_split(frame.drop("Time").withColumn("i", F.lit(1)), "Time", "i")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5), st.none()), min_size=1, max_size=40))
def test_histogram_cuts_equal_ranks(spark, times):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, t long")
    n = len(times)
    a, b = L.cut_points(n, 0.5, 0.2)
    ranked = sorted(range(n), key=lambda i: (times[i] is None, times[i] or 0, i))
    want = {i: "train" if k < a else "validation" if k < b else "test" for k, i in enumerate(ranked)}
    assert {r["id"]: r["split"] for r in L.temporal_split(df, "t", "id", 0.5, 0.2).rows.collect()} == want


@pytest.mark.parametrize("kind", ["long", "double", "string", "timestamp", "date"])
def test_split_counts_hold_for_nulls_ties_and_repeats(spark, kind):
    """The sizes are exact and the order holds, whatever is missing, tied or repeated."""
    import datetime as dt

    made = {"long": int, "double": float, "string": lambda x: f"a long name before the number {x:03}"[-28:], "timestamp": lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(x), "date": lambda x: dt.date(2024, 1, 1) + dt.timedelta(x)}[kind]
    tables = [
        [(i, None if i % 3 == 0 else made(i // 4)) for i in range(24)],  # a third of the times missing
        [(None if i % 2 else i, made(i // 8)) for i in range(20)],  # half of the ids missing
        [(1, made(5))] * 20,  # rows alike
        [(1, made(5))] * 9 + [(i, made(i)) for i in range(11)],
        [(i, None) for i in range(10)],
    ]
    if kind == "double":
        tables.append([(i, float("nan") if i % 2 else 1.0 * i) for i in range(20)])
    for k, rows in enumerate(tables):
        for parts in (1 + 2 * (k % 2),):
            df = spark.createDataFrame(rows, f"id long, t {kind}").repartition(parts)
            s = L.temporal_split(df, "t", "id")
            got = s.rows.collect()
            by = {name: [r for r in got if r["split"] == name] for name in ("train", "validation", "test")}
            assert [len(x) for x in by.values()] == [s.metadata[f"n_{x}"] for x in by] and len(got) == len(rows)
            place = lambda r: (r["t"] is None or r["t"] != r["t"], r["t"] if r["t"] is not None and r["t"] == r["t"] else made(0), r["id"] is None, r["id"] or 0)
            for x, y in (("train", "validation"), ("validation", "test")):
                assert not by[x] or not by[y] or max(map(place, by[x])) <= min(map(place, by[y]))
            assert s.rows.columns == ["id", "t", "split"]


def test_row_range_and_rows_at(spark):
    df = spark.createDataFrame([(i, (7 * i) % 40) for i in range(40)], "id long, t long")
    ranked = sorted(range(40), key=lambda i: (7 * i) % 40)
    for first, last in ((0, 0), (10, 15), (30, 99), (-3, 2), (50, 60)):
        assert sorted(r["id"] for r in L.row_range(df, "t", "id", first, last).collect()) == sorted(ranked[max(first, 0) : last + 1])
    wanted = spark.createDataFrame([(3,), (3,), (99,), (None,)], "id long")
    assert [r["id"] for r in L.rows_at(df, wanted, "id").collect()] == [3]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, float("nan")])), max_size=30))
def test_percentiles_are_exact(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None and v == v]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = percentiles(df, "x", shares)
    assert got == [None] * 6 if not known else np.allclose(got, np.quantile(known, shares), rtol=1e-12, atol=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-(2**62), 2**62).map(float)), min_size=1, max_size=30), st.data())
def test_kth_smallest_is_exact(spark, values, data):
    k = data.draw(st.integers(0, len(values) - 1))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = sorted(values)[k]
    assert kth_smallest(df, "x", k) == (want, sum(v < want for v in values))


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"), (F.col("id") % 5).alias("v"))
    rows = sorted(running_totals(df, "x", {"t": "v"}, buckets=9).collect(), reverse=True)
    at = 0
    for r in rows:
        at += r["v"]
        assert r["t"] == at


def test_histogram_cuts_on_real_events(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts")
    n, ranked = e.count(), e.orderBy("ts", "event_id").collect()
    a, b = L.cut_points(n, 0.7, 0.15)
    want = {r["event_id"]: "train" if k < a else "validation" if k < b else "test" for k, r in enumerate(ranked)}
    assert {r["event_id"]: r["split"] for r in L.temporal_split(e, "ts", "event_id").rows.collect()} == want


def test_missing_times_go_to_test(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), *[(i, float(i)) for i in range(2, 20)]], "id long, t double")
    got = {r["id"]: r["split"] for r in L.temporal_split(df, "t", "id").rows.collect()}
    assert got[0] == got[1] == "test"


def test_features_are_found_in_natural_order():
    assert feature_columns(["V10", "V2", "V1", "Value", "v3", "Amount", "Time"]) == ["V1", "V2", "V10", "Amount"]
    assert feature_columns(["V2", "V1"]) == ["V1", "V2"]


def test_scaling_fits_on_train_alone(frame):
    s = L.temporal_split(frame, "Time", "Time")
    out = build_features(s, keep=["Time"])
    m = out.train.agg(F.avg("Amount").alias("m"), F.stddev_pop("Amount").alias("s")).first()
    assert abs(m["m"]) < 1e-9 and abs(m["s"] - 1) < 1e-9
    assert out.metadata["scaled_columns"] == ["Amount"] and out.feature_columns[:2] == ("V1", "V2")
    changed = L.Split(s.rows.withColumn("Amount", F.when(F.col("split") == "test", 1e9).otherwise(F.col("Amount"))), (), s.metadata)
    again = build_features(changed, keep=["Time"])
    a, b = (x.train.orderBy("Time").select("Amount").collect() for x in (out, again))
    assert a == b
    assert build_features(s, []).feature_columns == out.feature_columns
    assert build_features(s, ["V1"]).metadata["scaler"] is None
    assert out.train.columns == ["Time", *out.feature_columns, "Class"]
    with pytest.raises(ContractError):
        build_features(s, ["V99"])


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r[0] for r in standard_scale(df, ["x"]).collect()] == [0.0, 0.0]
    assert [r[0] for r in minmax_scale(df, ["x"]).collect()] == [0.0, 0.0]
    assert standard_scale(df.limit(0), ["x"]).count() == 0


def test_csv_reads_missing_texts(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Time,Amount,Class,name\n0,1.0,0,a\n1,NA,1,\n2,nan,0,N/A\n3,NaN,1,b\n")
    df = T.read_csv(spark, p)
    assert df.columns == ["Time", "Amount", "Class", "name"]
    assert dict(df.dtypes) == {"Time": "bigint", "Amount": "double", "Class": "bigint", "name": "string"}
    assert [r["Amount"] for r in df.orderBy("Time").collect()] == [1.0, None, None, None]
    assert dict(T.read_csv(spark, p, T.transaction_schema()).dtypes)["Class"] == "int"
    with pytest.raises(FileNotFoundError):
        T.read_csv(spark, tmp_path / "none.csv")


def test_csv_and_zone_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    T.write_csv(df, str(tmp_path / "c"))
    T.write_csv(df.limit(0), str(tmp_path / "c"))
    assert T.read_csv(spark, tmp_path / "c").count() == 1
    for v in ("1", "2", "2"):
        path = T.write_zone(df, str(tmp_path), "features", "t", v)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        T.write_zone(df, str(tmp_path), "other", "t", "1")


def test_settings(tmp_path):
    assert T.Settings.from_mapping(None) == T.Settings()
    p = tmp_path / "c.yaml"
    p.write_text("data:\n  raw_path: x.csv\npreprocessing:\n  train_ratio: 0.6\n  validation_ratio: 0.2\n  test_ratio: 0.2\n  feature_columns: [V1]\n")
    got = T.Settings.from_yaml(p)
    assert got.data.raw_path == "x.csv" and got.preprocessing.feature_columns == ("V1",)
    p.write_text("")
    assert T.Settings.from_yaml(p) == T.Settings()
    with pytest.raises(TypeError):
        T.Settings.from_mapping({"preprocessing": {"other": 1}})
    with pytest.raises(ValueError):
        T.Settings.from_mapping({"preprocessing": {"train_ratio": 0.9}})


def test_small_operators(spark, frame):
    assert conforms(frame, T.transaction_schema(2)) != [] and conforms(frame, frame.schema) == []
    dirty = spark.createDataFrame([("1", None), ("x", 2.0), ("1", 3.0)], "a string, b double")
    assert sorted((r["a"], r["b"]) for r in cleaned(dirty, cast={"a": "int"}, fill={"a": 0}).filter("b > 0").collect()) == [(0, 2.0), (1, 3.0)]
    assert quarantine(dirty, {"b": F.col("b") > 2}).filter("size(reasons) > 0").count() == 2
    filled = impute_random(dirty, "b", 1).collect()
    assert all(r["b"] is not None and not math.isnan(r["b"]) for r in filled)
    assert T.two_moons(spark).count() == 100
    assert abs(sum(v * v for v in T.digit_images(spark, 3).first()["pixels"]) - 1) < 1e-9


def test_passenger_features(spark):
    schema = "PassengerId int, Name string, Sex string, Age double, SibSp int, Parch int, Ticket string, Fare double, Cabin string, Embarked string, Survived int"
    rows = [
        (1, "Doe, Mr. Jonathan", "male", 16.0, 0, 0, "t", 7.91, None, "S", 0),
        (2, "Roe, Dr. Ann", "female", 16.5, 1, 2, "t", 14.454, "C1", "C", 1),
        (3, "Poe, Mlle. Eva", "female", 65.0, 0, 0, "t", 31.0, None, None, 1),
        (4, "No title here at all", "male", None, 0, 1, "t", None, "D", "Q", 0),
        (5, "Loe, Mme. Ida", "female", 48.0, 0, 0, "t", 500.0, None, "S", 1),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["Name_length"]: r for r in passenger_features(df, df).collect()}
    john, ann, eva, none, ida = (got[len(r[1])] for r in rows)
    assert set(john.asDict()) == {"Sex", "Age", "Parch", "Fare", "Embarked", "Survived", "Name_length", "Has_Cabin", "FamilySize", "IsAlone", "Title"}
    assert [r["Title"] for r in (john, ann, eva, none, ida)] == [1, 5, 2, 0, 3]
    assert [r["Fare"] for r in (john, ann, eva, none, ida)] == [0, 1, 2, 2, 3]
    assert [r["Age"] for r in (john, ann, eva, ida)] == [0, 0, 4, 2] and none["Age"] in range(5)
    assert [(r["Sex"], r["Embarked"], r["Has_Cabin"], r["FamilySize"], r["IsAlone"]) for r in (john, ann, none)] == [(1, 0, 0, 1, 1), (0, 1, 1, 4, 0), (1, 2, 1, 2, 0)]
