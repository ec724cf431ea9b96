"""How many values lie below given ones: by one ordered pass over both, never by pairs."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.sources.tables import materialised

BUCKETS = 256
RADIX_BITS = 4


def cuts(values: DataFrame, column: str, buckets: int = BUCKETS) -> list[float]:
    """Ascending values that cut a column into ranges of about as many rows each, long-tailed ones too."""
    found = values.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted({x for x in found if abs(x) < float("inf")}) or [0.0]


def _bucketed(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """df with __b: how many of the cuts a value has reached."""
    splits = [-float("inf"), *at, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol="__b", handleInvalid="keep").transform(df).withColumn("__b", F.col("__b").cast("int"))


def counts_below(values: DataFrame, probes: DataFrame, keys: list[str], value: str, at: str, inclusive: bool = False, weight: str | None = None, split: bool = False) -> DataFrame:
    """probes, with below: how many of values with the same keys are below at (inclusive: at it or below), and of: how many
    there are; weight: a column of values that counts as so many. Equal values are counted before they are put in order.
    Without keys, or with split where a key may hold much of the input, ranges of values are put in order apart, so no task
    sees all of a key."""
    times = F.sum(weight) if weight else F.count("*")
    seen = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(times.alias("__c"))
    asked = probes.select(*keys, F.col(at).cast("double").alias("__v"), F.struct(*probes.columns).alias("__probe"))
    parts = list(keys)
    ranges = not keys or split
    if ranges:
        edges = cuts(values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v")), "__v")
        seen, asked = _bucketed(seen, "__v", edges), _bucketed(asked, "__v", edges)
        parts = [*keys, "__b"]
    none = F.lit(None).cast(asked.schema["__probe"].dataType)
    rows = seen.select(*parts, "__v", "__c", none.alias("__probe")).unionByName(asked.select(*parts, "__v", F.lit(0).cast("long").alias("__c"), "__probe"))
    first = F.col("__probe").isNotNull() if inclusive else F.col("__probe").isNull()  # false comes first
    order = Window.partitionBy(*parts).orderBy("__v", first)
    rows = rows.withColumn("below", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if not ranges:
        return rows.withColumn("of", F.sum("__c").over(Window.partitionBy(*parts))).where("__probe is not null").select("__probe.*", "below", "of")
    rows = rows.where("__probe is not null")
    per = seen.groupBy(*parts).agg(F.sum("__c").alias("__n"))
    if not keys:  # at most as many rows as there are ranges
        have = sorted((r["__b"], r["__n"]) for r in per.collect())
        whole = sum(n for _, n in have)
        offsets = [(b, sum(n for other, n in have if other < b)) for b in range(-1, len(edges) + 3)]
        offset = values.sparkSession.createDataFrame(offsets, "__b int, __offset long")
        return rows.join(F.broadcast(offset), "__b", "left").select("__probe.*", (F.col("below") + F.coalesce("__offset", F.lit(0))).alias("below"), F.lit(whole).cast("long").alias("of"))
    per = per.unionByName(asked.select(*parts, F.lit(0).cast("long").alias("__n")).distinct()).groupBy(*parts).agg(F.sum("__n").alias("__n"))
    running = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.select(*parts, F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__offset"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__of"))
    return rows.join(per, parts).select("__probe.*", (F.col("below") + F.col("__offset")).alias("below"), F.col("__of").alias("of"))


def counts_within(values: DataFrame, probes: DataFrame, x: str, x_at: str, y: str, y_at: str, probe_id: str) -> DataFrame:
    """probes, with upto: how many of values have x at x_at or below, within: how many of these have y below y_at, and of:
    how many there are. probe_id tells probes apart.

    Different x are numbered in order, and the numbers cut into blocks of 16, 256 and so on. The x that a probe takes in are
    some whole blocks of each size, fewer than 16, and in each block its y are counted in order."""
    points = values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))
    points = materialised(points, "points")  # values are read once; different points, their ranks and what is asked are written
    places = materialised(points.select("x").distinct(), "places")
    ranked = materialised(counts_below(places, points, [], "x", "x").select("y", "c", F.col("below").alias("rank")), "ranked")
    asked = counts_below(points, probes, [], "x", x_at, inclusive=True, weight="c").withColumnRenamed("below", "upto")
    asked = counts_below(places, asked.withColumnRenamed("of", "__of"), [], "x", x_at, inclusive=True).withColumnRenamed("below", "__r").withColumnRenamed("of", "__places").withColumnRenamed("__of", "of")
    asked = materialised(asked, "asked")
    most = places.count()
    levels = range(max(1, -(-most.bit_length() // RADIX_BITS)))
    block = lambda rank, level: F.shiftright(rank, RADIX_BITS * level)
    inside = ranked.select("y", "c", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), block(F.col("rank"), k).alias("block")) for k in levels))).alias("b")).select("y", "c", "b.*")

    def blocks(level: int):
        last = block(F.col("__r"), level)
        first = F.shiftleft(block(F.col("__r"), level + 1), RADIX_BITS)
        return F.when(last > first, F.transform(F.sequence(first, last - 1), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    parts = asked.select(probe_id, F.col(y_at).alias("__y"), F.explode(F.concat(*(blocks(k) for k in levels))).alias("b")).select(probe_id, "__y", "b.*")
    found = counts_below(inside, parts, ["level", "block"], "y", "__y", weight="c", split=True)
    return asked.drop("__r", "__places").join(found.groupBy(probe_id).agg(F.sum("below").alias("within")), probe_id, "left").withColumn("within", F.coalesce("within", F.lit(0)))
