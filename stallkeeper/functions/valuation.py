"""Scalar rules that turn statistics into money: tax, confidence, ceilings, asking prices. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# Tax by what an item sells for, and the least share of it that is left.
TAX = [(100e6, 0.025), (10e6, 0.02)]
LOW_TAX = 0.01
LEFT = 0.05


def after_tax(reference: Column, attempts: float = 1.0, sale_tax: float = 0.0) -> Column:
    rate = F.coalesce(*(F.when(reference >= least, share) for least, share in TAX), F.lit(LOW_TAX))
    return F.greatest(reference * (1 - rate * max(attempts, 1.0) - max(sale_tax, 0.0)), reference * LEFT)


def liquidity_factor(sell_through: Column, pivot: float = 0.7, k: float = 0.3, floor: float = 0.85) -> Column:
    return F.when(sell_through.isNull(), 1.0).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), 1 - k * (pivot - sell_through))))


def adjusted_price(price: Column, minor: Column) -> Column:
    """The price without what its minor features are worth, half of it at least."""
    return F.greatest(price - minor, price * 0.5)


def pool_confidence(samples: Column, volatility: Column, per_day: Column, manipulated: Column) -> Column:
    plain = 0.4 * F.least(samples / 12.0, F.lit(1.0)) + 0.4 * F.greatest(1 - volatility, F.lit(0.0)) + 0.2 * F.least(per_day / 3.0, F.lit(1.0))
    return F.when(manipulated, plain * 0.5).otherwise(plain)


def refine_confidence(base: Column, signals: list[Column], roi: Column, support: Column, samples: Column, volatility: Column, margin_penalty: float = 1.0) -> Column:
    """Lowers base where signals disagree or the margin is too good, less so for well-known prices."""
    valid = F.filter(F.array(*signals), lambda s: s > 0)
    top, low = F.array_max(valid), F.array_min(valid)
    agree = 0.6 + 0.4 * F.greatest(1 - (top - low) / top / 0.25, F.lit(0.0))
    penalty = F.when(F.size(valid) >= 2, agree).otherwise(0.85)
    margin = 1 / (1 + (roi - 0.6) * 0.8 * margin_penalty)
    margin = F.when(support >= 2, F.least(margin + 0.3, F.lit(1.0))).otherwise(margin)
    penalty = F.when((roi > 0.6) & F.lit(margin_penalty > 0), penalty * margin).otherwise(penalty)
    strength = F.least(samples / 12.0, F.lit(1.0)) * (1 - clamp(volatility, 0, 1))
    return clamp(base * (penalty + (1 - penalty) * strength), 0, 1)


def star_cost(level: Column, essence_each: float, master: list[float]) -> Column:
    """Essence for the first five stars, then the priced master stars up to the tenth."""
    prices = F.array(*(F.lit(float(x)) for x in master))
    masters = F.aggregate(F.slice(prices, 1, F.greatest(F.least(level, F.lit(10)) - 5, F.lit(0)).cast("int")), F.lit(0.0), lambda a, x: a + x)
    return F.least(level, F.lit(5)) * essence_each + masters


def craft_ceiling(parts: list[Column], stars: Column, mult: float = 1.1) -> Column:
    """What making the item costs: its dearest known base and its stars; null without a known base."""
    return (F.greatest(*parts) if len(parts) > 1 else parts[0]) * mult + stars * mult


def big_ticket(buy: Column, resale: Column, samples: Column, per_day: Column, profit_bar: float, margin: float, min_samples: int = 10, min_volume: float = 1.0) -> Column:
    """Whether a dear listing may pass on its profit alone: enough of it after tax, sold often enough, and at least margin
    of the resale price lies between the prices, before tax. A bar of 0 is off."""
    sane = F.lit(profit_bar > 0) & (resale > 0) & (buy > 0)
    return sane & (samples >= min_samples) & (per_day >= min_volume) & ((resale - buy) / resale >= margin) & (after_tax(resale) - buy >= profit_bar)


def open_price(target: Column, lbin: Column, learned: Column) -> Column:
    """An opening ask: a little over a target of sales, under a modelled one; a close lowest listing instead."""
    opened = F.floor(target * F.when(learned, 0.97).otherwise(1.05)).cast("double")
    return F.when(lbin.isNotNull() & (learned | (lbin >= 0.92 * target)), F.least(lbin - 1, opened)).otherwise(opened)


def listing_price(target: Column, lbin: Column, learned: Column, paid: Column, age_hours: Column, per_day: Column) -> tuple[Column, Column]:
    """Asking price and mode: opened; after 6 hours (12 where at most one sells a day) lowered by 2 percent a day, 25 at
    most; never below what was paid and a margin that shrinks with time."""
    patience = F.when(per_day <= 1, 12).otherwise(6)
    days = F.floor((age_hours - patience) / 24)
    old = age_hours >= patience
    opened = open_price(target, lbin, learned)
    lowered = F.floor(opened * (1 - F.least(0.02 * (days + 1), F.lit(0.25)))).cast("double")
    floor = F.when(old, F.ceil(paid * (1 + F.greatest(0.05 - 0.03 * (days + 1), F.lit(-0.10))))).otherwise(F.ceil(paid * 1.05)).cast("double")
    ask = F.when(old, lowered).otherwise(opened)
    mode = F.when(floor > ask, "cost_floor").when(old, "clearance").otherwise("open")
    return F.greatest(ask, F.coalesce(floor, F.lit(0.0))), mode


def price_at_depth(levels: Column, need: Column) -> Column:
    """Price of the first of a book side's levels (structs price, amount) by which need units are there; else null."""
    zero = F.struct(F.lit(0).cast("double").alias("seen"), F.lit(None).cast("double").alias("price"))
    walk = lambda a, x: F.struct((a["seen"] + x["amount"]).alias("seen"), F.when(a["price"].isNull() & (a["seen"] + x["amount"] >= need), x["price"]).otherwise(a["price"]).alias("price"))
    return F.aggregate(levels, zero, walk, lambda a: a["price"])


def units_ahead(levels: Column, ours: Column) -> Column:
    """Units that a buy order at ours has to wait for: those of strictly better levels."""
    return F.aggregate(F.filter(levels, lambda x: x["price"] > ours), F.lit(0.0), lambda a, x: a + x["amount"])


def short_money(x: Column) -> Column:
    return F.when(x >= 1e9, F.concat(F.format_number(x / 1e9, 1), F.lit("B"))).when(x >= 1e6, F.concat(F.format_number(x / 1e6, 1), F.lit("M"))).when(x >= 1e3, F.concat(F.format_number(x / 1e3, 0), F.lit("k"))).otherwise(F.format_number(x, 0))
