"""Feeds as Spark reads them: JSON and Parquet with fixed schemas; missing fields become nulls, bad rows go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRS = (
    "struct<id:string,attributes:map<string,double>,enchantments:map<string,double>,scrolls:array<string>,reforge:string,skin:string,recombobulated:boolean,upgrade_level:double,gem_slots:bigint,gems:array<string>,"
    "parts:array<string>,extras:map<string,double>,pet:struct<type:string,tier:string,exp:double,candied:boolean,heldItem:string,skin:string>,variant:string,itemUuid:string,count:bigint>"
)
LISTING = "uuid string, auctioneer string, item_name string, start bigint, starting_bid double, bin boolean, item_bytes string"
LEVEL = "array<struct<price:double,amount:double>>"
BOOK = f"product string, ts double, sell_price double, buy_price double, ask_levels {LEVEL}, bid_levels {LEVEL}"


def sold(spark: SparkSession, path: str, since: float) -> DataFrame:
    """Sales (auction_id, price, sold_at, seller, tts_ms, attrs as JSON text) since a time; rows whose attrs can't be read
    are left out. The time reaches the scan."""
    rows = spark.read.schema("auction_id string, item_id string, price double, bin boolean, sold_at double, attrs string, seller string, tts_ms double, buyer string").parquet(path)
    return rows.where(F.col("sold_at") >= since).withColumn("attrs", F.from_json("attrs", ATTRS)).where("attrs.id is not null")


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of a folder of JSON pages: fixed price, with a price and item bytes; of a uuid on several pages, one."""
    rows = spark.read.schema(f"page int, auctions array<struct<{', '.join(x.replace(' ', ':', 1) for x in LISTING.split(', '))}>>").json(path, multiLine=True)
    flat = rows.select("page", F.inline("auctions")).where("bin and starting_bid > 0 and item_bytes <> ''")
    cols = [c for c in flat.columns if c != "uuid"]
    return flat.groupBy("uuid").agg(F.min_by(F.struct(*cols), "page").alias("r")).select("uuid", "r.*")


def player_listings(spark: SparkSession, path: str) -> DataFrame:
    """As listings, of a seller; item bytes are text or an object with data."""
    rows = spark.read.text(path)
    raw = F.get_json_object("value", "$.item_bytes")
    return rows.select(F.get_json_object("value", "$.uuid").alias("uuid"), F.coalesce(F.get_json_object(raw, "$.data"), raw).alias("item_bytes"), F.get_json_object("value", "$.starting_bid").cast("double").alias("starting_bid"))


def book(spark: SparkSession, path: str) -> DataFrame:
    """Book snapshots with the price (selling, else buying; only above 0) and the top of either side."""
    rows = spark.read.schema(BOOK).json(path)
    price = F.when(F.col("sell_price") > 0, F.col("sell_price")).otherwise(F.col("buy_price"))
    return rows.withColumn("price", F.when(price > 0, price)).withColumn("ask", F.get("ask_levels", F.lit(0))["price"]).withColumn("bid", F.get("bid_levels", F.lit(0))["price"])


def fills(spark: SparkSession, path: str, keep: int = 50_000) -> DataFrame:
    """The newest fills of an append-only JSON-lines ledger; malformed lines are left out."""
    return spark.read.schema("ts double, source string, product string, gross double, tax double, cost double, hold_h double").option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("ts")).limit(keep)
