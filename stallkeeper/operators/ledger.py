"""Writers and ledgers as joins: inserts that ignore known rows, sales against listings, held items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTS_MOST_MS = 14 * 86_400_000
#: Rows that a task sorts or gathers by their id.
TASK_ROWS = 500_000


def tasks_for(rows: int) -> int:
    return rows // TASK_ROWS + 1


def insert_sold(existing: DataFrame, incoming: DataFrame, listings: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New rows of incoming (sale_id, sold_at s, ...) with tts_ms from listings (sale_id, start ms), where it lies between 0
    and 14 days; and the listings that are left. tasks: among how many tasks ids are dealt before they are gathered and
    joined, so that the memory of one doesn't grow with the rows."""
    if tasks:
        existing, incoming, listings = (x.repartition(tasks, "sale_id") for x in (existing, incoming, listings))
    new = incoming.dropDuplicates(["sale_id"]).join(existing.select("sale_id"), "sale_id", "left_anti")
    tts = F.col("sold_at") * 1000 - F.col("start")
    timed = new.join(listings.select("sale_id", "start"), "sale_id", "left").withColumn("tts_ms", F.when(tts.between(0, TTS_MOST_MS), tts)).drop("start")
    return timed, listings.join(incoming.select("sale_id"), "sale_id", "left_anti")


def record_first(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: the first of incoming per key that existing doesn't have."""
    first = incoming.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return first.join(existing.select(*keys), keys, "left_anti")


def split_stale(listings: DataFrame, cutoff: float, now_ms: Column | float) -> tuple[DataFrame, DataFrame]:
    """Listings still watched, and those first seen before cutoff as censored with their lifetime so far."""
    stale = listings.where(F.col("first_seen") < cutoff).withColumn("lifetime_ms", F.lit(now_ms) - F.col("start"))
    return listings.where(F.col("first_seen") >= cutoff), stale


def ring(rows: DataFrame, time: str, cutoff: float, n: int, tie: str) -> DataFrame:
    return rows.where(F.col(time) >= cutoff).orderBy(F.desc(time), tie).limit(n)


def last_write(rows: DataFrame, key: str, value: str, time: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(time, value)).alias(value), F.max(time).alias(time))


def held(ledger: DataFrame, stale: float) -> DataFrame:
    """Items per base key that are bought and unsold, or posted since stale and not yet bought."""
    bought = F.col("bought_at").isNotNull() & F.col("sold_at").isNull()
    pending = F.col("bought_at").isNull() & F.col("sold_at").isNull() & (F.col("posted_at") >= stale)
    return ledger.groupBy("bk").agg((F.count(F.when(bought, 1)) + F.count(F.when(pending, 1))).alias("held"))


def unlisted(ledger: DataFrame, bridge: DataFrame) -> DataFrame:
    """Bought items that no listing refers to, the newest purchase of each item."""
    return ledger.where("bought_at is not null").join(bridge.select("uuid"), "uuid", "left_anti").groupBy("item").agg(F.max_by("uuid", F.struct("bought_at", "uuid")).alias("uuid"))


def reconcile(ended: DataFrame, ledger: DataFrame, bridge: DataFrame) -> DataFrame:
    """Which posted flip an ended sale (sale_id, item_id, sold_at) belongs to: by the bridge of relisted items, by the
    auction itself, or the item's latest posting not after the sale; via names the tier."""
    by_bridge = ended.join(bridge.select(F.col("listing").alias("sale_id"), F.col("uuid").alias("b")), "sale_id", "left")
    by_uuid = by_bridge.join(ledger.select(F.col("uuid").alias("sale_id"), F.col("uuid").alias("d")), "sale_id", "left")
    asof = ended.join(ledger.select("item_id", F.col("uuid").alias("u"), "posted_at"), "item_id").where("posted_at <= sold_at").groupBy("sale_id").agg(F.max_by("u", F.struct("posted_at", "u")).alias("i"))
    out = by_uuid.join(asof, "sale_id", "left")
    return out.select("sale_id", F.coalesce("b", "d", "i").alias("uuid"), F.when(F.col("b").isNotNull(), "bridge").when(F.col("d").isNotNull(), "uuid").when(F.col("i").isNotNull(), "item").alias("via"))


def band_match(asks: DataFrame, book: DataFrame, share: float = 0.001, least: float = 1.0) -> DataFrame:
    """asks (id, fk, price) to the cheapest listing of the key within share of the price (least at least)."""
    near = asks.join(book.select("fk", F.col("uuid"), F.col("price").alias("p")), "fk").where(F.abs(F.col("p") - F.col("price")) <= F.greatest(F.col("price") * share, F.lit(least)))
    return near.groupBy("id").agg(F.min_by("uuid", F.struct("p", "uuid")).alias("uuid"))


def sighting(flips: DataFrame, sightings: DataFrame) -> DataFrame:
    """flips with the seller and time of the sighting of the same (item, price), null without one."""
    return flips.join(sightings.select("item", "price", F.col("seller").alias("seen_seller"), F.col("at").alias("seen_at")), ["item", "price"], "left")


def fill_row(paid: Column, got: Column, units: Column, tax: float) -> dict[str, Column]:
    """Derived columns of a ledger row from unit prices."""
    gross, cost = got * units, paid * units
    net = gross * (1 - tax) - cost
    return {"gross": gross, "tax": gross * tax, "net": net, "roi": F.when(cost > 0, net / cost)}


def gone(ledger: DataFrame, inventory: DataFrame, now: float, grace: float = 180) -> DataFrame:
    """Bought, unsold items, bought longer than grace seconds ago, that the inventory doesn't hold."""
    held = ledger.where(F.col("bought_at").isNotNull() & F.col("sold_at").isNull() & (F.col("bought_at") < now - grace))
    return held.join(inventory.select("item_id").distinct(), "item_id", "left_anti")


def bought_variant(ledger: DataFrame) -> DataFrame:
    """Per item_id the variant (behind ~, else empty) of the key that was posted last."""
    last = ledger.groupBy("item_id").agg(F.max_by("bk", F.struct("posted_at", "uuid")).alias("bk"))
    return last.select("item_id", F.regexp_extract("bk", r"~(.*)$", 1).alias("variant"))


def best_orphan(holdings: DataFrame, tracked: DataFrame, prices: DataFrame) -> DataFrame:
    """Per owner, of holdings (owner, product, units) that no position (owner, product) tracks, the one worth most."""
    loose = holdings.join(tracked.select("owner", "product"), ["owner", "product"], "left_anti").join(prices.select("product", "price"), "product")
    worth = F.col("units") * F.col("price")
    return loose.groupBy("owner").agg(F.max_by("product", F.struct(worth, "product")).alias("product"), F.max(worth).alias("worth"))
