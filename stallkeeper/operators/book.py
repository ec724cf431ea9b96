"""Order-book series of commodities: statistics and market-making plans. Snapshots: product, ts (s), ask, bid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.config import Book
from stallkeeper.functions import keys as k
from stallkeeper.functions import valuation as v


def product_stats(snapshots: DataFrame, c: Book, lag: int = 60, every: int = 10) -> DataFrame:
    """Per product: samples, stability (share with a spread after tax), upper medians of margin and ratio, rises of the bid
    an hour, and the upper median of moves over lag rows, taken at every n-th row."""
    seen = snapshots.groupBy("product").agg((F.max("ts") - F.min("ts")).alias("span"))
    rows = snapshots.where("ask > 0 and bid > 0")
    w = Window.partitionBy("product").orderBy("ts")
    mid = (F.col("ask") + F.col("bid")) / 2
    rows = rows.withColumn("mid", mid).withColumn("r", F.row_number().over(w) - 1).withColumn("up", F.when(F.col("bid") > F.lag("bid").over(w), 1).otherwise(0)).withColumn("was", F.lag("mid", lag).over(w))
    move = F.when((F.col("r") >= lag) & ((F.col("r") - lag) % every == 0) & (F.col("was") > 0), F.abs(F.col("mid") / F.col("was") - 1) * 100)
    net = F.col("ask") * (1 - c.tax) - F.col("bid")
    rows = rows.select("product", "up", net.alias("net"), (net / F.col("bid") * 100).alias("margin"), (F.col("ask") / F.col("bid")).alias("ratio"), move.alias("move"))
    base = rows.groupBy("product").agg(F.count("*").alias("samples"), F.avg((F.col("net") > 0).cast("double")).alias("stability"), F.sum("up").alias("ups"))
    for name in ("margin", "ratio", "move"):
        ranked = rows.where(F.col(name).isNotNull()).select("product", name, F.row_number().over(Window.partitionBy("product").orderBy(name)).alias("r"))
        counts = ranked.groupBy("product").agg(F.count("*").alias("m"))
        base = base.join(ranked.join(counts, "product").where(F.col("r") == F.floor(F.col("m") / 2) + 1).select("product", name), "product", "left")
    hours = F.greatest(F.col("span") / 3600.0, F.lit(1 / 60))
    return base.join(seen, "product").select("product", "samples", "stability", F.col("margin").alias("median_margin_pct"), F.col("ratio").alias("median_ratio"), (F.col("ups") / hours).alias("undercut_per_hour"), F.coalesce("move", F.lit(0.0)).alias("vol_pct"))


def buy_plans(products: DataFrame, stats: DataFrame, budget: float, c: Book) -> DataFrame:
    """products (product, ask, bid, flow, levels) with statistics: why no order is placed (null: it is), and the order."""
    t = products.join(stats, "product", "left").withColumn("buy_at", k.tick_up(F.col("bid"))).withColumn("units", F.floor(F.least(F.lit(budget) / F.col("buy_at"), F.col("flow"))).cast("double"))
    backed = v.price_at_depth(F.col("levels"), F.greatest(F.col("units"), F.lit(float(c.min_depth_units))))
    t = t.withColumn("exit_at", F.when(F.size("levels") == 0, k.tick_down(F.col("ask"))).otherwise(F.least(k.tick_down(F.col("ask")), backed))).withColumn("backed", backed)
    t = t.withColumn("net", F.col("exit_at") * (1 - c.tax) - F.col("buy_at")).withColumn("margin_pct", F.col("net") / F.col("buy_at") * 100)
    reason = F.coalesce(
        F.when((F.col("ask") <= 0) | (F.col("bid") <= 0), "one-sided book"), F.when(F.col("samples").isNull(), "no history"), F.when(F.col("samples") < c.min_samples, "history too thin"),
        F.when(F.col("stability") < c.min_stability, "spread not persistent"), F.when(F.col("units") < 1, "cannot afford one unit"), F.when((F.size("levels") > 0) & F.col("backed").isNull(), "sell side too thin"),
        F.when(F.col("net") <= 0, "no margin after tax"), F.when(F.col("margin_pct") < c.min_margin_pct, "margin below floor"), F.when(F.col("vol_pct") > F.col("margin_pct") / 2, "too volatile"),
    )
    return t.select("product", reason.alias("reason"), "buy_at", "units", "exit_at", "net", (F.col("net") * F.col("units") * c.fill_p / c.fill_hours).alias("score"))


def fill_summary(fills: DataFrame, by: list[str]) -> DataFrame:
    """fills (source.., gross, tax, cost, hold_h): totals, wins and losses, return, upper-median hold."""
    net = F.col("gross") - F.col("tax") - F.col("cost")
    base = fills.withColumn("net", net).groupBy(*by).agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.count(F.when(F.col("net") > 0, 1)).alias("wins"), F.count(F.when(F.col("net") < 0, 1)).alias("losses"), (F.sum("net") / F.sum("cost")).alias("roi"))
    hold = fills.select(*by, "hold_h", F.row_number().over(Window.partitionBy(*by).orderBy("hold_h")).alias("r")).join(base.select(*by, "n"), by).where(F.col("r") == F.floor(F.col("n") / 2) + 1)
    return base.join(hold.select(*by, "hold_h"), by)


def extremes(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n best and n worst rows, ties by tie."""
    best = df.orderBy(F.desc(value), tie).limit(n).withColumn("end", F.lit("best"))
    return best.unionByName(df.orderBy(F.asc(value), tie).limit(n).withColumn("end", F.lit("worst")))


def moved(snapshots: DataFrame, window_s: float) -> DataFrame:
    """snapshots (product, ts, ask, bid) with moved_pct: by how many percent a side has moved from its own median in the
    window before, the larger of both; 0 where there is none. A window's snapshots are few, since a book has one per tick."""
    before = Window.partitionBy("product").orderBy((F.col("ts") * 1_000_000).cast("long")).rangeBetween(-int(window_s * 1_000_000), -1)
    off = lambda side: F.when(F.col(f"{side}_median") > 0, F.abs(F.col(side) - F.col(f"{side}_median")) / F.col(f"{side}_median") * 100).otherwise(0.0)
    own = snapshots.withColumn("ask_median", F.sort_array(F.collect_list("ask").over(before))).withColumn("bid_median", F.sort_array(F.collect_list("bid").over(before)))
    middle = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    own = own.withColumn("ask_median", middle(F.col("ask_median"))).withColumn("bid_median", middle(F.col("bid_median")))
    return own.withColumn("moved_pct", F.greatest(off("ask"), off("bid"))).drop("ask_median", "bid_median")
