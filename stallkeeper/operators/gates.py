"""Routes and gates before a flip is sent: usable listings, clients' capacity, the base decision, trade messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions.counts import counts_within
from stallkeeper.operators.filters import first_reason


def usable(listings: DataFrame) -> DataFrame:
    """Fixed-price listings (bin, price, item_bytes) with a price and packed bytes to decode."""
    return listings.where(F.col("bin") & (F.col("price") > 0) & (F.length("item_bytes") > 0))


def route(listings: DataFrame, live: DataFrame) -> DataFrame:
    """Adds route: skip where not fixed-price, old where the uuid was live before, skip without bytes, else new."""
    seen = live.select("uuid").distinct().withColumn("__seen", F.lit(True))
    decodable = F.length(F.coalesce("item_bytes", F.lit(""))) > 0
    said = F.when(~F.coalesce("bin", F.lit(False)), "skip").when(F.col("__seen"), "old").when(decodable, "new").otherwise("skip")
    return listings.join(seen, "uuid", "left").withColumn("route", said).drop("__seen")


def ineligible(min_free: float, most_auctions: float, spend: float, purse_share: float, big_purse: float, full_profit: float, full_used: float, full_free: float = 0) -> Column:
    """Why a client (free, auctions, purse, at_limit, used) can't take a flip (price, profit), else null: no free slots, a
    full house, too large a share of the purse, or a profit below a big purse's or a full inventory's floor. A
    client that doesn't say at_limit and used counts as full with full_free free slots or fewer. A threshold of 0 is off."""
    on = lambda x: F.lit(x > 0)
    share = F.when(on(purse_share) & (F.col("purse") > big_purse), F.col("purse") * purse_share).otherwise(0.0)
    full = on(full_profit) & (F.lit(full_profit) > share) & F.coalesce(F.when(F.col("used").isNotNull(), F.col("at_limit") & (F.col("used") >= full_used)), F.col("free") <= full_free, F.lit(False))
    floor = F.when(full, full_profit).otherwise(share)
    return first_reason(
        (on(min_free) & (F.col("free") < min_free), "slots"), (on(most_auctions) & (F.col("auctions") >= most_auctions), "auctions"),
        (on(spend) & (F.col("purse") > 0) & (F.col("price") > F.col("purse") * spend), "purse"), ((floor > 0) & (F.col("profit") < floor) & full, "full"), ((floor > 0) & (F.col("profit") < floor), "floor"),
    )


def client_reasons(flips: DataFrame, clients: DataFrame, min_free: float, most_auctions: float, spend: float, purse_share: float, big_purse: float, full_profit: float, full_used: float, full_free: float = 0) -> DataFrame:
    """client, reason (passed, or as of ineligible()) and n: how many of flips (price, profit) each client (told by client)
    can't or can take. Prices and profits needn't go together: a client's affordable flips below its floor are counted by
    both at once. No pairs are made; clients with the same thresholds are asked once."""
    share = F.when(F.lit(purse_share > 0) & (F.col("purse") > big_purse), F.col("purse") * purse_share).otherwise(0.0)
    held = F.coalesce(F.when(F.col("used").isNotNull(), F.col("at_limit") & (F.col("used") >= full_used)), F.col("free") <= full_free, F.lit(False))
    own = clients.withColumn("share", share).withColumn("full", (F.lit(full_profit) > F.col("share")) & F.lit(full_profit > 0) & held)
    limited = F.lit(spend > 0) & (F.col("purse") > 0)
    own = own.withColumn("floor", F.when(F.col("full"), full_profit).otherwise(F.col("share"))).withColumn("most", F.when(limited, F.col("purse") * spend).otherwise(float("inf")))
    own = own.withColumn("floor", F.when(F.col("floor") > 0, F.col("floor")).otherwise(-float("inf")))
    whole = F.when(F.lit(min_free > 0) & (F.col("free") < min_free), "slots").when(F.lit(most_auctions > 0) & (F.col("auctions") >= most_auctions), "auctions")
    own = own.select("client", whole.alias("whole"), "full", "most", "floor")
    asked = own.select("most", "floor").distinct().withColumn("id", F.concat_ws("/", "most", "floor"))
    found = counts_within(flips, asked, "price", "most", "profit", "floor", "id").select("most", "floor", "upto", "within", "of")
    own = own.join(found, ["most", "floor"])
    n = lambda name, x: F.struct(F.lit(name).alias("reason"), x.cast("long").alias("n"))
    gated = F.array(n("purse", F.col("of") - F.col("upto")), n("full", F.when(F.col("full"), F.col("within")).otherwise(0)), n("floor", F.when(F.col("full"), 0).otherwise(F.col("within"))), n("passed", F.col("upto") - F.col("within")))
    per = own.select("client", F.explode(F.when(F.col("whole").isNotNull(), F.array(F.struct(F.col("whole").alias("reason"), F.col("of").alias("n")))).otherwise(gated)).alias("r"))
    return per.select("client", "r.*").where("n > 0")


def base_decision(hard_profit: float, blacklist: list[str], tier_passes: Column, blocked: list[str] | None = None) -> Column:
    """The first of: hard profit floor, blacklist (ids upper-cased), a blocked part of the column guard, tiers; null where
    the flip passes all."""
    guards = [(F.col("guard").contains(g), "guard") for g in blocked or [] if g]
    return first_reason((F.lit(hard_profit > 0) & (F.col("profit") < hard_profit), "hard"), (F.upper("item").isin([b.upper() for b in blacklist]), "blacklist"), *guards, (~tier_passes, "tiers"))


def not_own(listings: DataFrame, auctions: DataFrame, items: DataFrame) -> DataFrame:
    """Listings that neither are one's own auctions (uuid) nor hold one's own items (item_uuid)."""
    return listings.join(auctions.select("uuid"), "uuid", "left_anti").join(items.select("item_uuid"), "item_uuid", "left_anti")


# The forms of the messages.
_NUMBER = r"([0-9,]+)"
MESSAGES = [("buy_placed", "Buy Order Setup! ", " for "), ("sell_placed", "Sell Offer Setup! ", " for "), ("buy_filled", "Your Buy Order for ", " was filled"), ("sell_filled", "Your Sell Offer for ", " was filled")]


def trade_message(line: Column) -> Column:
    """Struct kind, units, name, coins of a market's chat line; null kind for any other line."""
    said = F.regexp_replace(F.trim(line), r"^\[Bazaar\] ", "")
    number = lambda pattern: F.regexp_replace(F.nullif(F.regexp_extract(said, pattern, 1), F.lit("")), ",", "").cast("double")
    kind = F.coalesce(*(F.when(said.startswith(start) & said.contains(end), F.lit(name)) for name, start, end in MESSAGES), F.when(said.startswith("You reached your maximum of "), "max_orders"), F.when(said.startswith("Your price isn't competitive"), "not_competitive"))
    units = F.coalesce(number(rf"^(?:Buy Order Setup! |Sell Offer Setup! |Your Buy Order for |Your Sell Offer for ){_NUMBER}x "), number(rf"^You reached your maximum of {_NUMBER}"))
    name = F.nullif(F.regexp_replace(F.regexp_extract(said, r"^[^0-9]*[0-9,]+x\s+(.*?)(?: for | was filled)", 1), r"\s+", " "), F.lit(""))
    coins = F.when(kind.isin("buy_placed", "sell_placed"), number(rf" for {_NUMBER} coins"))
    return F.struct(kind.alias("kind"), units.alias("units"), name.alias("name"), coins.alias("coins"))
