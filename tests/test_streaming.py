import pytest
from pyspark.sql import functions as F

from normcast.operators import behavior as B
from normcast.streaming import twins as W


@pytest.fixture()
def source(spark, small, tmp_path):
    path = str(tmp_path / "in")
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(path)
    return path, e


def _equal_when_closed(stream_rows, batch_rows, keys):
    have = {tuple(r[k] for k in keys): r["n"] for r in stream_rows.collect()}
    want = {tuple(r[k] for k in keys): r["n"] for r in batch_rows.collect()}
    assert have and all(want[k] == v for k, v in have.items())
    return len(have), len(want)


@pytest.mark.parametrize("slide", [None, "12 hours"])
def test_window_velocity(spark, source, tmp_path, slide):
    path, e = source
    stream = W.window_velocity(W.event_stream(spark, path, e.schema), "user_id", "ts", "1 day", slide)
    got = W.run_once(stream, f"velocity_{slide and 'slide'}", str(tmp_path / "c"))
    _equal_when_closed(got, W.window_velocity(e, "user_id", "ts", "1 day", slide), ["user_id", "start"])


def test_sessions(spark, source, tmp_path):
    path, e = source
    got = W.run_once(W.session_activity(W.event_stream(spark, path, e.schema), "user_id", "ts"), "sessions", str(tmp_path / "c"))
    _equal_when_closed(got, W.session_activity(e, "user_id", "ts"), ["user_id", "start"])


def test_duplicates_go(spark, source, tmp_path):
    path, e = source
    e.limit(50).write.mode("append").parquet(path)
    got = W.run_once(W.deduplicated(W.event_stream(spark, path, e.schema), ["event_id"], "ts", "60 days"), "deduplicated", str(tmp_path / "c"))
    assert got.count() == e.count()


def test_running_baseline(spark, source, tmp_path):
    path, e = source
    stream = W.running_deviation(W.event_stream(spark, path, e.schema), "user_id", "event_id", "ts", "value")
    got = W.run_once(stream, "deviations", str(tmp_path / "c"))
    assert got.count() == e.count() and got.filter("deviation IS NOT NULL").count() > 0


@pytest.mark.parametrize("rows", [1, 10, 10_000])
def test_running_baseline_equals_batch_form(spark, source, tmp_path, rows):
    """Whatever the size of Arrow batches, and with missing amounts."""
    path, e = source
    e = e.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    e.repartition(3).write.mode("overwrite").parquet(f"{path}-nulls")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        stream = W.running_deviation(W.event_stream(spark, f"{path}-nulls", e.schema), "user_id", "event_id", "ts", "value")
        got = {r["id"]: r["deviation"] for r in W.run_once(stream, f"deviations_{rows}", str(tmp_path / "c")).collect()}
    finally:
        spark.conf.set(name, before)
    want = {r["event_id"]: r["amount_deviation"] for r in B.amount_deviation(e, "user_id", "ts", "event_id", "value").collect()}
    assert set(got) == set(want)
    for i, x in want.items():
        assert (got[i] is None) == (x is None) and (x is None or abs(got[i] - x) < 1e-6 * max(1, abs(x)))


def test_stream_joins(spark, source, tmp_path):
    path, e = source
    fitted = e.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    got = W.run_once(W.scored_against(W.event_stream(spark, path, e.schema), fitted, "user_id", "value"), "scored", str(tmp_path / "c1"))
    assert got.count() == e.count()
    a, b = (W.event_stream(spark, path, e.schema).filter(f"event_type = '{k}'") for k in ("error", "purchase"))
    got = W.run_once(W.within_interval(a, b, "user_id", "ts", 86_400, "60 days"), "near", str(tmp_path / "c2"))
    want = W.within_interval(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), "user_id", "ts", 86_400)
    assert got.count() == want.count()
