"""Behaviour of accounts over time. Every feature of a row reads only what came before it.

The formulas are this project's own: rows of an account in order of time, then id.
"""

from __future__ import annotations

import math
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from normcast.functions.scalar import ratio
from normcast.operators.ordered import running_totals


def _past(account: str, time: str, id_: str):
    return Window.partitionBy(account).orderBy(time, id_).rowsBetween(Window.unboundedPreceding, -1)


def amount_deviation(df: DataFrame, account: str, time: str, id_: str, amount: str, out: str = "amount_deviation") -> DataFrame:
    """Deviations of the amount from the account's earlier mean; null while that has no deviation."""
    w = _past(account, time, id_)
    return df.withColumn(out, ratio(F.col(amount) - F.avg(amount).over(w), F.stddev_samp(amount).over(w)))


def normal_range(df: DataFrame, account: str, time: str, id_: str, amount: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Earlier quantiles of the amount, and whether the amount lies out of them. Nulls don't count; NaN is the greatest value.

    Between neighbours a and b a quantile is a * (1 - share) + b * share, the first product not rounded, as the other engine has it: its last
    bit decides whether amounts that equal a quantile lie out of the range.
    Rows stream by account in order of time; the earlier amounts are kept sorted, 8 bytes each.
    """

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, n_nan = (), array("d"), 0
        for batch in batches:
            lows, highs = [], []
            for k, x in zip(batch.column(account).to_pylist(), batch.column("__x").to_pylist()):
                if now != (k,) and not (now and k != k and now[0] != now[0]):
                    now, seen, n_nan = (k,), array("d"), 0
                for out, q in ((lows, low), (highs, high)):
                    out.append(_between(seen, n_nan, q))
                if x is not None:
                    if x != x:
                        n_nan += 1
                    else:
                        insort(seen, x)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lows, pa.float64()), pa.array(highs, pa.float64())], [*batch.schema.names[:-1], "low", "high"])

    rows = df.drop("low", "high").withColumn("__x", F.col(amount).cast("double"))
    schema = StructType([*rows.drop("__x").schema, StructField("low", DoubleType()), StructField("high", DoubleType())])
    out = rows.repartition(account).sortWithinPartitions(account, time, id_).mapInArrow(ranged, schema)
    return out.withColumn("out_of_range", F.coalesce((F.col(amount) < F.col("low")) | (F.col(amount) > F.col("high")), F.lit(False)).cast("int"))


def _between(ordered: Sequence[float], n_nan: int, share: float) -> float | None:
    """A quantile of sorted values that ``n_nan`` NaN follow."""
    n = len(ordered) + n_nan
    if not n:
        return None
    p = (n - 1) * share
    i, j = math.floor(p), math.ceil(p)
    a, b = (ordered[x] if x < len(ordered) else math.nan for x in (i, j))
    if i == j or not (math.isfinite(a) and math.isfinite(b)):
        return a if i == j else a * (1 - (p - i)) + b * (p - i)
    return math.fma(a, 1 - (p - i), b * (p - i))


def velocity(df: DataFrame, account: str, time: str, window_seconds: int, out: str = "velocity") -> DataFrame:
    """Rows of the account within the window that ends with this row's time, itself counted."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(account).orderBy(us).rangeBetween(-window_seconds * 1_000_000, 0)
    return df.withColumn(out, F.count("*").over(w))


def partner_frequency(df: DataFrame, account: str, partner: str, time: str, id_: str, out: str = "partner_frequency") -> DataFrame:
    """Share of the account's earlier rows that have this row's partner."""
    by_both = Window.partitionBy(account, partner).orderBy(time, id_).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, ratio(F.count("*").over(by_both), F.count("*").over(_past(account, time, id_))))


def place_deviation(df: DataFrame, account: str, place: str, time: str, id_: str, out: str = "place_deviation") -> DataFrame:
    """One less the share of earlier rows in this row's place; null for the first row."""
    return partner_frequency(df, account, place, time, id_, out).withColumn(out, 1 - F.col(out))


def hour_deviation(df: DataFrame, account: str, time: str, id_: str, out: str = "hour_deviation") -> DataFrame:
    """Distance on the clock, in hours, from the mean direction of the account's earlier hours."""
    w = _past(account, time, id_)
    hour = (F.hour(time) + F.minute(time) / 60.0).cast("double")
    minute = F.hour(time) * 60 + F.minute(time)
    # where earlier hours cancel out, the last bits decide: looked up, as the JVM's sines of some minutes differ from the C library's
    turns = [(h + m / 60.0) * math.pi / 12 for h in range(24) for m in range(60)]
    sine, cosine = (F.get(F.array(*[F.lit(f(t)) for t in turns]), minute) for f in (math.sin, math.cos))
    mean = F.atan2(F.avg(sine).over(w), F.avg(cosine).over(w)) * 12 / F.lit(math.pi)
    apart = F.abs(hour - F.when(mean < 0, mean + 24).otherwise(mean))
    return df.withColumn(out, F.when(mean.isNotNull(), F.least(apart, 24 - apart)))


def timeline(df: DataFrame, account: str, time: str, id_: str, amount: str, last: int = 3) -> DataFrame:
    """Seconds since the account's row before, change of amount, and the mean of the ``last`` rows before."""
    w = Window.partitionBy(account).orderBy(time, id_)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return (
        df.withColumn("seconds_since", (us - F.lag(us).over(w)) / 1_000_000.0)
        .withColumn("change", F.col(amount) - F.lag(amount).over(w))
        .withColumn("recent_mean", F.avg(amount).over(w.rowsBetween(-last, -1)))
    )


def frame_values(df: DataFrame, account: str, time: str, id_: str, amount: str, reach: int = 2) -> DataFrame:
    """Values of other frames: ``second`` (the account's second amount so far), ``around`` (mean of up to ``reach`` rows on either
    side and the row itself) and ``without_self`` (the same without the row: an excluded current row is one that is taken off)."""
    w = Window.partitionBy(account).orderBy(time, id_)
    near = w.rowsBetween(-reach, reach)
    x = F.col(amount)
    total, n = F.sum(x).over(near) - F.coalesce(x, F.lit(0)), F.count(x).over(near) - F.when(x.isNotNull(), 1).otherwise(0)
    return (
        df.withColumn("second", F.nth_value(amount, 2).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("around", F.avg(x).over(near))
        .withColumn("without_self", F.when(n > 0, total / n))
    )


def attention_rank(df: DataFrame, score: str, tiers: int = 4) -> DataFrame:
    """Rank of every row by score, highest first and ties alike, and its tier; missing scores rank last.

    Distinct scores are counted and their counts summed in ranges, so no task sees all of them.
    """
    counts = df.groupBy(score).agg(F.count("*").alias("__n"))
    known = running_totals(counts.filter(F.col(score).isNotNull()), score, {"__upto": "__n"})
    total = counts.agg(F.sum("__n").alias("__all"), F.sum(F.when(F.col(score).isNotNull(), F.col("__n"))).alias("__known"))
    own = known.select(F.col(score).alias("__s"), (F.col("__upto") - F.col("__n") + 1).alias("__rank"))
    out = df.join(own, F.col(score) == F.col("__s"), "left").crossJoin(F.broadcast(total))
    rank = F.coalesce(F.col("__rank"), F.coalesce(F.col("__known"), F.lit(0)) + 1)
    return out.withColumn("attention_rank", rank).withColumn("tier", (F.floor((F.col("attention_rank") - 1) * tiers / F.col("__all")) + 1).cast("int")).drop("__s", "__all", "__known", "__rank")


def as_of(rows: DataFrame, facts: DataFrame, account: str, time: str, columns: Sequence[str], prefix: str = "asof_") -> DataFrame:
    """Every row with the latest fact of its account at its time or before: one shuffle, one sort.

    Facts at the same time come before the row. Facts of one time: the last in order of their values.
    """
    f = facts.select(account, time, F.lit(0).alias("__side"), F.struct(*columns).alias("__fact"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("__row"))
    r = rows.select(account, time, F.lit(1).alias("__side"), F.lit(None).cast(f.schema["__fact"].dataType).alias("__fact"), F.struct(*rows.columns).alias("__row"))
    w = Window.partitionBy(account).orderBy(time, "__side", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(r).withColumn("__latest", F.last("__fact", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select("__row.*", *[F.col(f"__latest.{c}").alias(prefix + c) for c in columns])


def sessions(df: DataFrame, account: str, time: str, gap_seconds: int) -> DataFrame:
    """``(account, start, end, n)`` of runs of rows less than the gap apart."""
    out = df.groupBy(F.session_window(F.col(time).cast("timestamp"), f"{gap_seconds} seconds").alias("w"), account).agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("end"))
    return out.select(account, "start", "end", "n")


def reference_window(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows of the reference period, its end excluded. The period has no default."""
    return df.filter((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def baseline(df: DataFrame, account: str, amount: str, place: Column, hour: Column) -> DataFrame:
    """One row for each account: range of amounts, rows, most frequent place and mean hour."""
    places = df.groupBy(account, place.alias("place")).agg(F.count("*").alias("k")).groupBy(account).agg(F.max(F.struct("k", "place")).alias("m"))
    stats = df.groupBy(account).agg(F.count("*").alias("n"), F.percentile(amount, 0.05).alias("low"), F.percentile(amount, 0.95).alias("high"), F.avg(hour).alias("mean_hour"))
    return stats.join(places, account).select(account, "n", "low", "high", "mean_hour", F.col("m.place").alias("usual_place"))
