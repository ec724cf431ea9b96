"""Exact order statistics whose index rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_list(value: str | Column) -> Column:
    """Aggregate: the group's values ascending. Only for groups that are bounded before (newest rows of a key)."""
    return F.sort_array(F.collect_list(value))


def rank_percentile(values: Column, p: float) -> Column:
    """The element at floor(p * (n - 1)) of an ascending array."""
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    """The middle, or the upper of two middles, of an ascending array."""
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def _cumulated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, __upto (rows up to it), n: equal values are counted first, so a window holds different values only and
    spills, where an aggregate would hold all of a group."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    own = Window.partitionBy(*keys)
    upto = F.sum("__c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, value, upto.alias("__upto"), F.sum("__c").over(own).alias("n"))


def at_share(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the count n and, for each share p, the element at floor(p * n) (the last one at most)."""
    least = lambda p: F.least(F.floor(F.col("n") * p) + 1, F.col("n"))
    picks = [F.min(F.when(F.col("__upto") >= least(p), F.col(value))).alias(name) for name, p in shares.items()]
    return _cumulated(df, keys, value).groupBy(*keys, "n").agg(*picks)


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the count n and the median: the middle element, or the mean of the two middle ones."""
    at = lambda place: F.min(F.when(F.col("__upto") >= place, F.col(value)))
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    return _cumulated(df.where(F.col(value).isNotNull()), keys, value).groupBy(*keys, "n").agg(middle.alias("median"))


def newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key; order: columns, newest first, that leave no ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def span_days(times: str | Column, most: float) -> Column:
    """Aggregate: days between the first and last of epoch seconds, from half a day to most."""
    return F.least(F.greatest((F.max(times) - F.min(times)) / 86400.0, F.lit(0.5)), F.lit(float(most)))


def seller_floor(df: DataFrame, keys: list[str], row_id: list[str]) -> DataFrame:
    """Each seller's cheapest sale per key (the newest of equal prices); sales without a seller all stay."""
    who = F.coalesce(F.nullif("seller", F.lit("")), F.concat_ws("/", F.lit("#"), *row_id))
    best = df.groupBy(*keys, who.alias("who")).agg(F.min(F.struct("price", (-F.col("sold_at")).alias("t"))).alias("b"))
    return best.select(*keys, "who", F.col("b.price").alias("price"), (-F.col("b.t")).alias("sold_at"))


def multiset_contains(have: Column, need: Column) -> Column:
    """Whether have holds each element of need at least as often as need does."""
    return F.forall(F.array_distinct(need), lambda x: F.size(F.filter(need, lambda y: y == x)) <= F.size(F.filter(have, lambda y: y == x)))
