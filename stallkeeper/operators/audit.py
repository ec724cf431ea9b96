"""Looking back: what rejected listings would have fetched, and own purchases that turn up for sale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import orderstats as o


def missed(log: DataFrame, realised: DataFrame, fee: float = 0.0112, least: int = 3, better: float = 0.05) -> DataFrame:
    """log (uuid, fk, price, reference: rejected listings and what they were thought worth) with margin, realised (the upper
    median of the key's realised sales, fk and price), gain (after the fee, over the ask) and outcome: won where the sale
    would have brought better than the ask by more than the share better, else lost; unknown where fewer than least sales
    are known. Rows without an ask above 0 are left out."""
    medians = o.at_share(realised.where("price is not null"), ["fk"], "price", {"realised": 0.5}).where(F.col("n") >= least)
    t = log.where("price > 0").join(medians.select("fk", "realised"), "fk", "left")
    net = F.col("realised") * (1 - fee)
    outcome = F.when(net.isNull(), "unknown").when(net > F.col("price") * (1 + better), "won").otherwise("lost")
    margin = F.when(F.col("reference") > 0, (F.col("reference") - F.col("price")) / F.col("reference"))
    return t.withColumns({"margin": margin, "gain": net - F.col("price"), "outcome": outcome})


def by_margin(missed: DataFrame, edges: list[float]) -> DataFrame:
    """Per band of the margin (how many of the ascending edges it has reached; null without a reference): rows, those with
    a known outcome, won and lost ones, what winners would have gained and losers lost."""
    band = F.when(F.col("margin").isNotNull(), sum((F.when(F.col("margin") >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    count = lambda name: F.count(F.when(F.col("outcome") == name, 1))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("outcome") == name, F.abs("gain"))), F.lit(0.0))
    return missed.groupBy(band.alias("band")).agg(F.count("*").alias("n"), (count("won") + count("lost")).alias("known"), count("won").alias("won"), count("lost").alias("lost"), total("won").alias("gained"), total("lost").alias("spared"))


def own_relists(listings: DataFrame, purchases: DataFrame, basis: DataFrame) -> DataFrame:
    """uuid, item_uuid, flip: listings (uuid, item_uuid) of items that one has bought and not listed (purchases: flip,
    item_uuid, bought_at; of several the newest), if their cost is known (basis: item_uuid)."""
    newest = purchases.where("item_uuid is not null").groupBy("item_uuid").agg(F.max_by("flip", F.struct("bought_at", "flip")).alias("flip"))
    return listings.join(newest, "item_uuid").join(basis.select("item_uuid"), "item_uuid", "left_semi").select("uuid", "item_uuid", "flip")
