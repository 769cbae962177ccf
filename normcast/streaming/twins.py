"""Streaming forms of the behavioural features; each equals its batch form on windows that have closed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark, path: str, schema, time: str = "ts") -> DataFrame:
    """Parquet files as a stream; the time becomes a timestamp with zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def window_velocity(events: DataFrame, account: str, time: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows of each account in tumbling or sliding windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), account).agg(F.count("*").alias("n")).select(account, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_activity(events: DataFrame, account: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), account).agg(F.count("*").alias("n")).select(account, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """One row for each key within the watermark's reach."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


class RunningBaseline(StatefulProcessor):
    """Per account: rows, mean and squared deviations so far (Welford); scores each row before it counts.

    An account's rows of one trigger are brought in order together, however many batches they come in (24 bytes a row
    are held); an earlier time that comes with a later trigger counts from then on. Missing amounts have no score and count for nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, mean double, m2 double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.seen.get() if self.seen.exists() else (0, 0.0, 0.0)
        held = pd.concat([b[["id", "ts", "amount"]] for b in rows], ignore_index=True).sort_values(["ts", "id"], na_position="first", kind="stable")
        scores = np.full(len(held), np.nan)
        for i, x in enumerate(held["amount"].to_numpy(float).tolist()):
            if x != x:
                continue
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            if sd > 0:
                scores[i] = (x - mean) / sd
            n += 1
            step = x - mean
            mean += step / n
            m2 += step * (x - mean)
        self.seen.update((n, mean, m2))
        ids = held["id"].to_numpy()
        for at in range(0, len(ids), 10_000):
            part = pd.Series(scores[at : at + 10_000])
            yield pd.DataFrame({"id": ids[at : at + 10_000], "deviation": part.astype(object).where(part.notna(), None)})

    def close(self) -> None:
        pass


def running_deviation(events: DataFrame, account: str, id_: str, time: str, amount: str) -> DataFrame:
    """``(id, deviation)`` against each account's earlier rows, by state; needs the RocksDB state store."""
    rows = events.select(F.col(account).alias("account"), F.col(id_).alias("id"), F.col(time).alias("ts"), F.col(amount).alias("amount"))
    return rows.groupBy("account").transformWithStateInPandas(RunningBaseline(), "id long, deviation double", "Append", "None")


def scored_against(events: DataFrame, fitted: DataFrame, account: str, amount: str) -> DataFrame:
    """A stream joined with a fitted table of accounts (account, mean, sd)."""
    return events.join(fitted, account, "left").withColumn("deviation", F.try_divide(F.col(amount) - F.col("mean"), F.col("sd")))


def within_interval(left: DataFrame, right: DataFrame, account: str, time: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Rows of the left stream with the right stream's rows of the account up to ``seconds`` later; both sides are watermarked."""
    a = left.select(F.col(account).alias("a_account"), F.col(time).alias("a_time"), F.col("event_id").alias("a_id"))
    b = right.select(F.col(account).alias("b_account"), F.col(time).alias("b_time"), F.col("event_id").alias("b_id"))
    if left.isStreaming:
        a, b = a.withWatermark("a_time", late), b.withWatermark("b_time", late)
    near = (F.col("b_time") > F.col("a_time")) & (F.col("b_time") <= F.col("a_time") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, (F.col("a_account") == F.col("b_account")) & near)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is into a table in memory: for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
