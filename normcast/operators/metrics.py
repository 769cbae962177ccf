"""Evaluation of scores and predictions against labels. The positive class is 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normcast.functions.scalar import ratio
from normcast.operators.ordered import running_totals


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    def count(y: int, p: int) -> Column:
        return F.count_if((F.col(label) == y) & (F.col(prediction) == p))

    return df.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))


def rates(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, errors, sensitivity, specificity, false positive and negative rates."""
    c = confusion(df, label, prediction)
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), (fp + fn).alias("n_errors"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(class, precision, recall, f1, support)`` of 0 and 1, their plain mean and their mean by support; 0 where undefined."""
    c = confusion(df, label, prediction)
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.col(t).alias("t"), F.col(p).alias("p"), F.col(n).alias("n")) for k, t, p, n in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn"))])
    one = c.select(F.inline(rows)).withColumn("support", F.col("t") + F.col("n"))
    one = one.withColumn("precision", F.coalesce(ratio(F.col("t"), F.col("t") + F.col("p")), F.lit(0.0))).withColumn("recall", F.coalesce(ratio(F.col("t"), F.col("support")), F.lit(0.0)))
    one = one.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("class", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    macro = one.agg(F.lit("macro").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = one.agg(F.lit("weighted").alias("class"), *[F.coalesce(ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(n) for n in names], F.sum("support").alias("support"))
    return one.unionByName(macro).unionByName(weighted)


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """By distinct score from the highest: true and false positives at or over it. Rows are as many as distinct scores; scores are not null."""
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    return running_totals(by.withColumn("q", F.col("n") - F.col("p")), "threshold", {"tp": "p", "fp": "q"}).select("threshold", "p", "n", "tp", "fp")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area, ties counted half; null without both classes."""
    c = threshold_curve(df, score, label)
    # each positive beats the negatives with lower scores, and half of those with its own
    won = F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2.0))
    return c.agg(ratio(won, F.sum("p") * F.sum(F.col("n") - F.col("p"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise sum of precision over recall, tied scores together; null without positives."""
    c = threshold_curve(df, score, label)
    return c.agg(ratio(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")).alias("average_precision"))


def precision_at(df: DataFrame, score: str, label: str, id_col: str, ks: Sequence[int]) -> DataFrame:
    """``(k, precision)`` of the k highest scores, ties to the smaller id. Only max(ks) rows are ranked."""
    top = df.select(score, label, id_col).orderBy(F.col(score).desc(), id_col).limit(max(ks))
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.col(score).desc(), id_col)))
    one = ranked.agg(*[F.avg(F.when(F.col("r") <= k, F.col(label))).alias(f"k{k}") for k in ks])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("precision")) for k in ks])))


def calibration(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """By bin of equal width over 0..1: rows, mean score and share of positives."""
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def by_period(df: DataFrame, time: str, unit: str, label: str, prediction: str) -> DataFrame:
    """Recall, precision and rows in each period: whether quality lasts."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(F.date_trunc(unit, time).alias("period")).agg(F.count("*").alias("n"), ratio(F.count_if(y & p), F.count_if(y)).alias("recall"), ratio(F.count_if(y & p), F.count_if(p)).alias("precision"))


def disagreement(a: DataFrame, b: DataFrame, id_col: str, label: str, prediction: str) -> DataFrame:
    """Both right, only one right, both wrong: two predictions of the same rows."""
    right = (F.col(f"b.{prediction}") == F.col(f"a.{label}")).alias("b_right")
    j = a.alias("a").join(b.alias("b"), id_col).select((F.col(f"a.{prediction}") == F.col(f"a.{label}")).alias("a_right"), right)
    return j.agg(F.count_if(F.col("a_right") & F.col("b_right")).alias("both"), F.count_if(F.col("a_right") & ~F.col("b_right")).alias("only_a"), F.count_if(~F.col("a_right") & F.col("b_right")).alias("only_b"), F.count_if(~F.col("a_right") & ~F.col("b_right")).alias("neither"))


def outcomes(df: DataFrame, label: str, prediction: str, score: str, threshold: float, margin: float) -> DataFrame:
    """Rows with their outcome (tp, fp, fn, tn) and whether the score is within the margin of the threshold."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    name = F.when(y & p, "tp").when(~y & p, "fp").when(y & ~p, "fn").otherwise("tn")
    return df.withColumn("outcome", name).withColumn("borderline", (F.abs(F.col(score) - threshold) <= margin).cast("int"))
