"""Orders on a commodity market: every gate a buy order has to pass, sell offers, and plans in order of their score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import keys as k
from stallkeeper.functions import valuation as v
from stallkeeper.operators.filters import first_reason


@dataclass(frozen=True)
class Buying:
    blacklist: tuple[str, ...] = ()
    min_unit_price: float = 0
    min_samples: int = 60
    moved_pct: float = 0  # how far a side may lie from its recent median; 0 is off
    max_ratio: float = 3.0
    min_stability: float = 0.5
    max_undercut_per_hour: float = 60
    min_flow: float = 0  # units a day on the thinner side
    max_coins: float = float("inf")
    max_flow_share: float = 1.0
    max_units: float = 71_680
    units_per_slot: float = 64
    reserve: int = 0  # slots kept for what doesn't stack
    min_depth_units: float = 64
    tax: float = 0.0125
    min_margin_pct: float = 3.0
    buy_p: float = 0.55
    sell_p: float = 0.32
    buy_h: float = 0.215
    sell_h: float = 1.78


def unstackable(product: Column, name: Column) -> Column:
    return product.startswith("ENCHANTMENT_") | F.lower(name).contains("enchanted book")


def recent_medians(snapshots: DataFrame, now: float, window_s: float) -> DataFrame:
    """product, bid_median and ask_median over the last window_s seconds of snapshots (product, ts, ask, bid)."""
    last = snapshots.where((F.col("ts") >= now - window_s) & (F.col("ts") <= now))
    return last.groupBy("product").agg(F.median("bid").alias("bid_median"), F.median("ask").alias("ask_median"))  # a window holds few ticks


def moved_too_far(ask: Column, bid: Column, c: Buying) -> Column:
    off = lambda live, was: F.when(was > 0, F.abs(live - was) / was * 100).otherwise(0.0)
    return F.lit(c.moved_pct > 0) & (F.greatest(off(bid, F.col("bid_median")), off(ask, F.col("ask_median"))) > c.moved_pct)


def buy_plans(products: DataFrame, stats: DataFrame, budget: float, free_slots: int, c: Buying) -> DataFrame:
    """products (product, name, ask, bid, buy_week, sell_week, ask_levels, and quarantined, holding, resting: booleans that
    may be null) with stats (product, samples, bid_median, ask_median, median_ratio, stability, undercut_per_hour,
    vol_pct): reason (null: the order is placed), the order, its margin and its score, expected coins an hour.
    Gates are asked in turn, and the first that fails is the reason. Without levels the best ask is believed."""
    t = products.join(stats, "product", "left")
    ask, bid = F.col("ask"), F.col("bid")
    t = t.withColumn("flow", F.least("buy_week", "sell_week") / 7.0).withColumn("buy_at", k.tick_up(bid))
    slots = F.lit(float(max(free_slots - c.reserve, 0))) * F.when(unstackable(F.col("product"), F.col("name")), 1.0).otherwise(c.units_per_slot)
    wanted = F.least(F.lit(float(budget)) / F.col("buy_at"), F.lit(c.max_coins) / F.col("buy_at"), F.col("flow") * c.max_flow_share, F.lit(float(c.max_units)), slots)
    t = t.withColumn("units", F.floor(wanted).cast("double")).withColumn("__slots", slots)
    t = t.withColumn("__backed", v.price_at_depth(F.col("ask_levels"), F.greatest("units", F.lit(float(c.min_depth_units)))))
    has_levels = F.coalesce(F.size("ask_levels") > 0, F.lit(False))
    t = t.withColumn("exit_at", F.when(has_levels, F.least(k.tick_down(ask), F.col("__backed"))).otherwise(k.tick_down(ask)))
    t = t.withColumn("net_unit", F.col("exit_at") * (1 - c.tax) - F.col("buy_at")).withColumn("margin_pct", F.col("net_unit") / F.col("buy_at") * 100)
    reason = first_reason(
        (F.col("holding"), "already holding"), (F.col("resting"), "closed too recently"), (F.col("product").isin(list(c.blacklist)), "blacklisted"), (F.col("quarantined"), "quarantined"),
        (F.coalesce((ask <= 0) | (bid <= 0), F.lit(True)), "one-sided book"), (bid < c.min_unit_price, "unit price below floor"), (F.col("samples").isNull(), "no history"), (F.col("samples") < c.min_samples, "history too thin"),
        (moved_too_far(ask, bid, c), "price moved too far, too fast"), (ask / F.nullif(bid, F.lit(0.0)) > c.max_ratio, "book too wide right now"), (F.col("median_ratio") > c.max_ratio, "book too wide to be real"),
        (F.col("stability") < c.min_stability, "spread not persistent"), (F.col("undercut_per_hour") > c.max_undercut_per_hour, "outbid too often"), (F.coalesce(F.col("flow") < c.min_flow, F.lit(True)), "flow too thin on one side"),
        (F.col("name").isNull(), "no display name"), (F.col("__slots") < 1, "no inventory slot for this buy"), (F.col("units") < 1, "cannot afford one unit"), (has_levels & F.col("__backed").isNull(), "sell side too thin for this size"),
        (F.col("net_unit") <= 0, "no margin after tax"), (F.col("margin_pct") < c.min_margin_pct, "margin below floor"), (F.col("vol_pct") > F.col("margin_pct") / 2, "too volatile for the margin"),
    )
    score = F.col("net_unit") * F.col("units") * (c.buy_p * c.sell_p) / max(c.buy_h + c.sell_h, 0.01)
    return t.select("product", reason.alias("reason"), *(F.when(reason.isNull(), x).alias(n) for n, x in [(n, F.col(n)) for n in ("buy_at", "units", "exit_at", "net_unit", "margin_pct")] + [("score", score)]))


def sell_plans(positions: DataFrame, book: DataFrame, c: Buying) -> DataFrame:
    """positions (id, product, buy_price, units) against book (product, ask): an offer a tick below the best ask, or why there
    is none; a product that isn't in the book has no ask side. A position's cost is covered after tax."""
    t = positions.join(book.select("product", "ask"), "product", "left").withColumn("offer", k.tick_down(F.col("ask")))
    reason = first_reason((F.coalesce(F.col("ask") <= 0, F.lit(True)), "no ask side"), (F.col("offer") < F.col("buy_price") / (1 - c.tax), "ask below break-even"))
    net = F.col("offer") * (1 - c.tax) - F.col("buy_price")
    cells = {"offer": F.col("offer"), "net_unit": net, "margin_pct": net / F.nullif("buy_price", F.lit(0.0)) * 100, "score": net * F.col("units") / max(c.sell_h, 0.01)}
    return t.select("id", "product", reason.alias("reason"), *(F.when(reason.isNull(), x).alias(n) for n, x in cells.items()))


def ranked(plans: DataFrame, n: int) -> DataFrame:
    """The n placed plans of highest score, ties by product."""
    return plans.where("reason is null").orderBy(F.desc("score"), "product").limit(n)


def rejected(plans: DataFrame) -> DataFrame:
    """reason and n: how many products each gate stops; placed orders count as placed."""
    return plans.groupBy(F.coalesce("reason", F.lit("placed")).alias("reason")).agg(F.count("*").alias("n"))
