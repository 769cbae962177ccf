"""Contiguous shards of equal bytes from global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normcast.llm.scratch import dropped, shuffle_width, written


def text_bytes(text: F.Column) -> F.Column:
    """UTF-8 bytes of a text (null: none) and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row.

    In ascending order of id (null first; rows of one id by the CRC and size of their text), a row
    belongs to the shard in whose equal part of all bytes its middle lies. Shards are contiguous, in
    order, and differ from the equal part by at most the size of their two outer rows. ``slot`` counts
    a shard's rows from 0. Repeated rows each have a place. A row larger than a part may leave a
    shard empty. An empty table gives no row. Other columns are ignored.

    Only id, size and CRC move: a range exchange orders them, each partition's totals (one row each)
    give the bytes and rows before it, and running sums within partitions give the rest.
    """
    text = F.col(text_col)
    slim = written(docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")), "sizes")
    ranged = slim.repartitionByRange(2 * shuffle_width(docs.sparkSession), "id", "text_crc32", "size", F.rand(1)).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"), F.sum("b").over(Window.partitionBy()).alias("total"))
    totals = written(totals, "totals")
    inside = Window.partitionBy("part").orderBy("id", "text_crc32", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(upto)).withColumn("row", F.row_number().over(inside) - 1).join(totals, "part")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = placed.withColumn("m", middle).withColumn("shard", F.expr(f"CAST((m * {n_shards}) DIV (2 * total) AS INT)"))
    placed = written(placed.select("id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("row")).alias("rank")), "placed")
    first = written(placed.groupBy("shard").agg(F.min("rank").alias("first")), "first")
    dropped(slim, ranged, totals)
    return placed.join(first, "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, places: DataFrame, folder: str, *, id_col: str = "doc_id") -> None:
    """Write the rows of ``docs`` (unique ids) as Parquet, one folder ``shard=N`` each, in the order of their slots."""
    own = places.select(F.col("id").alias("__id"), F.col("shard").alias("shard_"), F.col("slot").alias("slot_"))
    rows = docs.join(own, docs[id_col].eqNullSafe(own["__id"])).drop("__id")
    rows = rows.repartitionByRange(shuffle_width(docs.sparkSession), "shard_", "slot_").sortWithinPartitions("shard_", "slot_")
    rows.withColumnRenamed("shard_", "shard").withColumnRenamed("slot_", "slot").write.partitionBy("shard").parquet(folder)
