"""Order positions beside the market: what is outbid, behind or given up, and who holds the stock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions.keys import tick_down


@dataclass(frozen=True)
class Stale:
    abandon_min: float = 1440
    reprice_min: float = 30
    keep_hours: float = 2  # an outbid order stays if what is ahead of it trades in so many hours
    stale_gap: float = 0.02
    requote_min: float = 30
    requotes: int = 3
    requote_gap: float = 0.01
    tax: float = 0.0125


def units_ahead(bids: Column, price: Column) -> Column:
    """Units of the bids (price, amount) above a price."""
    return F.aggregate(F.filter(bids, lambda b: b["price"] > price), F.lit(0.0), lambda a, b: a + F.greatest(b["amount"], F.lit(0.0)))


def keeps_place(ahead: Column, hourly: Column, ours: Column, best: Column, c: Stale) -> Column:
    """Whether an outbid order is worth leaving in its place: the gap is small, and what is ahead trades soon."""
    return F.lit(c.keep_hours > 0) & (ours > 0) & (best > ours) & ((best - ours) / ours <= c.stale_gap) & (hourly > 0) & (ahead <= hourly * c.keep_hours)


def stale_buys(positions: DataFrame, book: DataFrame, now_ms: float, c: Stale = Stale()) -> DataFrame:
    """positions (product, placed_ms, buy_price, offered_ms, ...) whose buy order should go, with reason: abandoned by age,
    whatever the book has, or outbid. book: product, bids (dearest first), weekly (units sold into bids in a week).
    Positions with an offer are done buying."""
    age = (F.lit(now_ms) - F.col("placed_ms")) / 60_000.0
    joined = positions.where("offered_ms is null").join(book.select("product", "bids", "weekly"), "product", "left")
    best = F.get("bids", F.lit(0))["price"]
    hourly = F.greatest(F.col("weekly"), F.lit(0.0)) / (7 * 24.0)
    outbid = (best > F.col("buy_price")) & ~keeps_place(units_ahead(F.col("bids"), F.col("buy_price")), hourly, F.col("buy_price"), best, c)
    reason = F.when(age > c.abandon_min, "abandoned").when((age >= c.reprice_min) & outbid, "outbid")
    return joined.withColumn("reason", reason).where("reason is not null").drop("bids", "weekly")


def stale_sells(positions: DataFrame, book: DataFrame, now_ms: float, c: Stale = Stale()) -> DataFrame:
    """positions (product, offered_ms, ask, buy_price, repriced, orphan) whose offer lies behind by more than requote_gap,
    with front: the price a tick below the best ask. Those that the new price would sell below cost stay, but for orphans,
    whose cost isn't known."""
    joined = positions.where("offered_ms is not null and ask is not null").join(book.select("product", "best_ask"), "product")
    front = tick_down(F.col("best_ask"))
    rested = (F.lit(now_ms) - F.col("offered_ms")) / 60_000.0 >= c.requote_min
    behind = (front > 0) & (F.col("ask") > 0) & (front < F.col("ask") * (1 - c.requote_gap))
    covered = F.col("orphan") | (front >= F.col("buy_price") / (1 - c.tax))
    due = F.lit(c.requote_min > 0) & (F.col("repriced") < c.requotes) & rested & behind & covered
    return joined.withColumn("front", front).where(due).drop("best_ask")


def with_stock(positions: DataFrame, book: DataFrame, holdings: DataFrame) -> DataFrame:
    """positions (owner, product, baseline, ...) with the market's best_bid and best_ask, own_units (what the owner holds
    beyond its baseline) and holder: the owner with most units of the product, null where nobody has one."""
    held = holdings.groupBy("owner", "product").agg(F.sum("units").alias("units"))
    most = held.where("units >= 1").groupBy("product").agg(F.max_by("owner", F.struct("units", "owner")).alias("holder"))
    own = positions.join(book.select("product", "best_bid", "best_ask"), "product", "left").join(held, ["owner", "product"], "left").join(most, "product", "left")
    return own.withColumn("own_units", F.greatest(F.coalesce("units", F.lit(0.0)) - F.col("baseline"), F.lit(0.0))).drop("units")
