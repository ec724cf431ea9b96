"""Which flips a user's tier rules let through, at what price scale and priority, and why not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.operators.filters import first_reason

RULE = ("rule_no", "kind", "min_profit", "min_roi", "min_confidence", "min_volume", "max_sell_ms", "priority", "scale")
DAY_MS = 86_400_000.0


@dataclass(frozen=True)
class Limits:
    """What flips need that no rule fits. An extreme flip (a profit bar of 0 is off) needs neither confidence nor volume.
    Measured times to sell count from min_times on, and where enough listings are known to sell."""

    min_profit: float = 0
    min_roi: float = 0
    min_confidence: float = 0
    min_volume: float = 0
    scale: float = 0.97
    extreme_profit: float = 0
    extreme_roi: float = 0
    measured_times: bool = False
    min_sell_through: float = 0
    min_times: int = 6


def money(x: Column) -> Column:
    """1.2M from a million on, else whole thousands: 12k."""
    return F.when(F.abs(x) >= 1e6, F.format_string("%.1fM", x / 1e6)).otherwise(F.concat(F.round(x / 1000).cast("bigint"), F.lit("k")))


def plain(x: Column) -> Column:
    """A number as text, without decimals where it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def percent(x: Column) -> Column:
    return F.round(x * 100).cast("bigint").cast("string")


def fits(matcher: Column, fields: Column) -> Column:
    """Whether each of matcher's entries (key, value: array) holds for fields (a map): two numbers are a range with its ends,
    any other count a list of values. A field or list that is missing doesn't fit; no entries fit everything."""

    def holds(e: Column) -> Column:
        x, want = F.try_element_at(fields, e["key"]), e["value"]
        ranged = (x >= F.get(want, F.lit(0))) & (x <= F.get(want, F.lit(1)))
        return F.coalesce(F.when(F.size(want) == 2, ranged).otherwise(F.array_contains(want, x)), F.lit(False))

    return F.coalesce(F.forall(matcher, holds), F.lit(True))


def sell_ms(c: Limits) -> tuple[Column, Column]:
    """The measured time to sell where it can be trusted, else null, and the estimate: this, or a day by the volume."""
    confirmed = F.coalesce(F.col("sell_through") >= c.min_sell_through, F.lit(c.min_sell_through <= 0))
    real = F.when(F.lit(c.measured_times) & confirmed & (F.col("tts_samples") >= c.min_times) & (F.col("fair_tts_ms") > 0), F.col("fair_tts_ms"))
    return real, F.coalesce(real, F.when(F.col("volume") > 0, F.lit(DAY_MS) / F.col("volume")))


def _failure(r: Column, extreme: Column, real: Column, estimate: Column) -> Column:
    """Why a flip fails a rule, else null; bounds that a rule leaves out are null and hold."""
    quick = F.coalesce(real <= r["max_sell_ms"], F.lit(False))
    sold = F.coalesce(F.col("volume") >= r["min_volume"], F.lit(False))
    return first_reason(
        (F.col("profit") < r["min_profit"], F.concat(F.lit("profit<"), money(r["min_profit"]))),
        (F.col("roi") < r["min_roi"], F.concat(F.lit("roi<"), plain(r["min_roi"]), F.lit("%"))),
        ((F.col("confidence") < r["min_confidence"]) & ~extreme, F.concat(F.lit("conf<"), percent(r["min_confidence"]), F.lit("%"))),
        (r["min_volume"].isNotNull() & ~sold & ~extreme & ~quick, F.concat(F.lit("vol<"), plain(r["min_volume"]))),
        (estimate > r["max_sell_ms"], F.lit("too slow to sell")),
    )


def decide(flips: DataFrame, rules: DataFrame, c: Limits) -> DataFrame:
    """id, pass, scale, priority and reason of flips (id, item, fields: map of numbers, profit, roi in percent, confidence,
    volume a day, fair_tts_ms, tts_samples, sell_through) under rules (rule_no, item or GLOBAL, kind: consider or blacklist,
    matcher: map of arrays, min_profit, min_roi, min_confidence, min_volume, max_sell_ms, priority, scale).

    A blacklist rule that fits rejects. Else the passed rule of highest priority decides, the first of equals, those for
    all items before an item's own. Else the limits for all, with their scale. Else the last failed rule gives the reason.
    A rule without priority has 0, without scale 1. Rules are a user's short list: they become one array an item,
    which flips are joined to, so no pairs of flips and rules are shuffled; no rules at all leave the limits."""
    rule = F.struct(*RULE, F.map_entries("matcher").alias("matcher"))
    lists = rules.groupBy(F.col("item").alias("__of")).agg(F.array_sort(F.collect_list(rule)).alias("__rules"))
    everywhere = lists.where("__of = 'GLOBAL'").select(F.col("__of").alias("__all"), F.col("__rules").alias("__everywhere"))  # a row at most
    none = F.array().cast(lists.schema["__rules"].dataType)
    own = flips.join(lists.where("__of <> 'GLOBAL'"), F.col("__of") == F.col("item"), "left").withColumn("__all", F.lit("GLOBAL")).join(F.broadcast(everywhere), "__all", "left")
    own = own.withColumn("__fit", F.filter(F.concat(F.coalesce("__everywhere", none), F.coalesce("__rules", none)), lambda r: fits(r["matcher"], F.col("fields"))))
    extreme = F.coalesce(F.lit(c.extreme_profit > 0) & (F.col("profit") >= c.extreme_profit) & (F.col("roi") >= c.extreme_roi), F.lit(False))
    real, estimate = sell_ms(c)
    verdict = lambda r, i: F.struct(_failure(r, extreme, real, estimate).alias("reason"), F.coalesce(r["priority"], F.lit(0.0)).alias("priority"), (-i).alias("turn"), F.coalesce(r["scale"], F.lit(1.0)).alias("scale"))
    own = own.withColumn("__said", F.transform(F.filter("__fit", lambda r: r["kind"] == "consider"), verdict))
    passed = F.transform(F.filter("__said", lambda s: s["reason"].isNull()), lambda s: F.struct(s["priority"].alias("priority"), s["turn"].alias("turn"), s["scale"].alias("scale")))
    own = own.withColumn("__best", F.array_max(passed)).withColumn("__why", F.get(F.filter("__said", lambda s: s["reason"].isNotNull()), F.size(F.filter("__said", lambda s: s["reason"].isNotNull())) - 1)["reason"])
    banned = F.exists("__fit", lambda r: r["kind"].eqNullSafe("blacklist"))
    general = (F.col("profit") >= c.min_profit) & (F.col("roi") >= c.min_roi) & (F.col("confidence") >= c.min_confidence) & F.coalesce(F.col("volume") >= c.min_volume, F.lit(True))
    passes = ~banned & (F.col("__best").isNotNull() | F.coalesce(general, F.lit(False)))
    below = F.concat(F.lit("below global (profit "), money(F.col("profit")), F.lit(", roi "), F.round("roi").cast("bigint"), F.lit("%, conf "), percent(F.col("confidence")), F.lit("%) and no tier matched"))
    return own.select(
        "id", passes.alias("pass"), F.when(passes, F.coalesce("__best.scale", F.lit(c.scale))).otherwise(1.0).alias("scale"), F.when(passes, F.coalesce("__best.priority", F.lit(0.0))).otherwise(0.0).alias("priority"),
        F.when(banned, F.concat(F.lit("blacklisted ("), "item", F.lit(")"))).when(~passes, F.coalesce("__why", below)).alias("reason"),
    )
