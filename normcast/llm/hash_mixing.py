"""Mixing sources to target weights by hash thresholds found in histograms. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normcast.llm.scratch import dropped, written

#: Runs of characters other than ASCII white space.
WHITE = "[\\x20\\x09-\\x0D]+"
#: The 60 bits of a row's hash are resolved to its first 12, its first 24, then all of them.
_SHIFTS = (60, 48, 36, 0)


def word_count(text: F.Column) -> F.Column:
    """Words of a text; 0 of null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WHITE), "")), F.lit(0)).cast("long")


def row_hash(id_: F.Column, text: F.Column, seed: int) -> F.Column:
    """60 bits of MD5 of the id (of the text where that is null): the same in every engine and run."""
    key = F.concat(F.coalesce(id_.cast("string"), text, F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Budgets of sources from ``(source, source_size)``, one row each.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    sizes. None gets over ``most`` times its size: with caps in ascending order of cap / weight, a
    source is capped where its cap is below its share of what the earlier ones leave. That is where
    sharing the excess again and again ends. Rows are as many as sources.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", cap)
    every = Window.partitionBy()
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", F.col("level").alias("level")))).over(every)["level"]
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final)).select("source", "source_size", "target")


def thresholds(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target, times, below)`` for rows ``(source, size, h)``.

    A source takes all its rows ``times`` times and those with ``h < below`` once more. ``below`` is
    found from sums by hash bucket, 4,096 of a source: the first whose running sum passes the budget
    is the boundary, and only its rows are summed by the 4,096 buckets within it; of the boundary
    among these, about one row in 16 million, rows are summed by their exact hash. The row (or rows
    of equal hash) at the boundary is taken where that comes nearer to the budget.
    Smaller budgets take subsets of what larger ones take.
    """
    if most < 1 or most != int(most):
        raise ValueError(f"the most must be a whole number of times, not {most}")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = written(plan.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")), "plan")
    edge = plan.select("source", "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    made = []
    for above, shift in zip(_SHIFTS, _SHIFTS[1:]):
        held = edge.select(F.col("source").alias("s"), "left", "prefix", "before")
        at = rows.join(held, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", above) == F.col("prefix")))
        sums = at.groupBy("source", "left", "before", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("prefix"))
        passed = sums.withColumn("run", F.col("before") + run).filter(F.col("run") > F.col("left"))
        first = passed.groupBy("source", "left").agg(F.min(F.struct("prefix", "run", "n")).alias("x"))
        edge = written(first.select("source", "left", "x.prefix", (F.col("x.run") - F.col("x.n")).alias("before"), F.col("x.run").alias("after")), "boundary")
        made.append(edge)
    nearer = (F.col("after") - F.col("left")) < (F.col("left") - F.col("before"))
    cut = edge.select(F.col("source").alias("s"), F.col("prefix") + F.when(nearer, 1).otherwise(0)).toDF("s", "cut")
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    whole = F.col("times") >= int(most)
    below = F.when(whole, F.lit(0)).otherwise(F.coalesce("cut", F.lit(0))).cast("long")
    table = written(out.select("source", "source_size", "target", F.when(whole, int(most)).otherwise(F.col("times")).alias("times"), below.alias("below")), "thresholds")
    dropped(plan, *made)
    return table


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """``(id, source, size, source_size, target, epochs, taken)`` of every row: how often the mix takes it.

    Size is words. Whole rows are taken, never parts, so a source misses its target by at most half
    of the size at the boundary. Null texts have size 0, null sources are one source, null ids hash
    by their text. Repeated rows and ids share a hash and are taken alike. An empty table gives no
    row. Other columns are ignored. ``most`` is a whole number, else a ValueError. Sources are ranked by one task, a row each: for some millions of them at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col), seed).alias("h"))
    rows = written(rows, "sizes")
    plan = thresholds(rows, weights, share, most).withColumnRenamed("source", "s")
    epochs = F.col("times") + (F.col("h") < F.col("below")).cast("int")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("epochs", epochs)
    return out.select("id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as ``mix`` takes it."""
    id_, text, source = docs[id_col], docs[text_col], docs[source_col]
    rows = written(docs.select(source.alias("source"), word_count(text).alias("size"), row_hash(id_, text, seed).alias("h")), "sizes")
    plan = thresholds(rows, weights, share, most)
    dropped(rows)
    epochs = plan["times"] + (row_hash(id_, text, seed) < plan["below"]).cast("int")
    taken = docs.join(plan, source.eqNullSafe(plan["source"])).filter(epochs > 0)
    return taken.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), epochs)).alias("__copy")).select(*[F.col(f"`{c}`") for c in docs.columns])
