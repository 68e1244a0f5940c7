"""How well decisions do: rates with intervals, calibration, ranking and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.stats import rate, wilson


def strongest_label(labels: DataFrame, rank: Column, order: str) -> DataFrame:
    """(subject, fails): of several labels the one from the strongest source, of equals the last."""
    return labels.groupBy("subject").agg(F.max_by("fails", F.struct(-rank, order)).alias("fails"))


def grade(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of (fails, outcome) rows; outcome is fail, review or pass, and review counts as a miss of a failing subject."""
    fails, found = F.col("fails"), F.col("outcome") == "fail"
    counted = rows.groupBy(*by).agg(F.count_if(fails & found).alias("tp"), F.count_if(~fails & found).alias("fp"), F.count_if(fails & ~found).alias("missed"), F.count_if(~fails & ~found).alias("tn"))
    tp, fp, missed, tn = (F.col(c) for c in ("tp", "fp", "missed", "tn"))
    low, high = wilson(tp, tp + fp)
    return counted.select(*by, "tp", "fp", "missed", "tn", rate(tp, tp + fp).alias("precision"), low.alias("precision_low"), high.alias("precision_high"), rate(fp, fp + tn).alias("fpr"), rate(tp, tp + missed).alias("recall"), rate(missed, tp + missed).alias("fnr"))


def brier(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("fails").cast("double"), 2)).alias("brier"), F.count("*").alias("n"))


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Chance that a failing subject has the higher p, ties half: from average ranks over the distinct values of p."""
    values = rows.groupBy(*by, "p").agg(F.count("*").alias("n"), F.count_if("fails").alias("f"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("rank", before + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("f")).alias("r"), F.sum("f").alias("nf"), F.sum(F.col("n") - F.col("f")).alias("np"))
    return sums.select(*by, rate(F.col("r") - F.col("nf") * (F.col("nf") + 1) / 2, F.col("nf") * F.col("np")).alias("auroc"))


def ece(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error: by tenth of p, how far failures and summed p lie apart, over all rows."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    apart = rows.groupBy(*by, b.alias("_b")).agg(F.abs(F.sum(F.col("fails").cast("double")) - F.sum("p")).alias("d"), F.count("*").alias("n"))
    return apart.groupBy(*by).agg((F.sum("d") / F.sum("n")).alias("ece"))


def agreement(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: subjects that both decided, how many alike, and which were right and no longer are."""
    both = old.select("subject", F.col("outcome").alias("a"), "fails").join(new.select("subject", F.col("outcome").alias("b")), "subject")
    right = lambda c: (F.col(c) == "fail") == F.col("fails")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("alike"), F.count_if(right("a") & ~right("b")).alias("regressions"))


def band(rows: DataFrame, precision: float) -> DataFrame:
    """One row: the lowest p from which the Wilson lower bound of the precision of all rows above stays at a target.

    Counted over the distinct values of p, from the highest down; null if none qualifies.
    """
    values = rows.groupBy("p").agg(F.count("*").alias("n"), F.count_if("fails").alias("f"))
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, _ = wilson(F.sum("f").over(down), F.sum("n").over(down))
    return values.withColumn("low", low).agg(F.min(F.when(F.col("low") >= precision, F.col("p"))).alias("threshold"))


def shortfall(graded: DataFrame, precision: float, recall: float) -> DataFrame:
    """What a policy still misses: precision first, then recall; null where met, and unknown over nothing."""
    what = F.when(F.col("precision").isNull() | F.col("recall").isNull(), "unknown").when(F.col("precision") < precision, "precision").when(F.col("recall") < recall, "recall")
    return graded.withColumn("shortfall", what)
