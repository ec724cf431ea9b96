"""Kaplan-Meier estimates over right-censored times to sell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve(events: DataFrame, censored: DataFrame) -> DataFrame:
    """item, t, at_risk, sold, survival from events and censored (item, t). At equal times sales come before losses.
    Rows are pre-aggregated per item and time, so a window holds distinct times only."""
    both = events.select("item", "t", F.lit(1).alias("d")).unionByName(censored.select("item", "t", F.lit(0).alias("d")))
    steps = both.groupBy("item", "t").agg(F.sum("d").alias("sold"), F.count("*").alias("leaving"))
    after = Window.partitionBy("item").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = Window.partitionBy("item").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = steps.withColumn("at_risk", F.sum("leaving").over(after))
    return risk.withColumn("survival", F.product(1 - F.col("sold") / F.col("at_risk")).over(upto)).select("item", "t", "at_risk", "sold", "survival")


def sell_through(curves: DataFrame, horizon: float) -> DataFrame:
    """Share sold by horizon."""
    return curves.groupBy("item").agg((1 - F.coalesce(F.min(F.when(F.col("t") <= horizon, F.col("survival"))), F.lit(1.0))).alias("sell_through"))


def median_time(curves: DataFrame) -> DataFrame:
    """First time at which half have sold; null if never."""
    return curves.groupBy("item").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_t"))
