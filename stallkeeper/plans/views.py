"""Sales, listings, ledgers and order books as views of the driver's tables, for Spark and (WITH clauses) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.config import Pricing
from stallkeeper.functions import keys as k
from stallkeeper.sources.tables import materialised

#: The tables' sales span years and their prices lie far apart.
CONFIG = Pricing(max_age_days=3650, min_share=1.43, short_hours=24 * 365, ref_cap=40)
DAY = 86_400
NOW = 1_009_843_200  # 2002-01-01, pinned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> F.Column:
    return F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sale_id, item, bk, features, price, sold_at, seller, buyer, tts_ms. Sellers whose key is divisible by 10 stay
    unnamed. The key columns alone aren't unique, so sale_id has all that tells rows apart."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = line.join(orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), line.l_orderkey == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand", "p_type", "p_size"), line.l_partkey == F.col("p_partkey"))
    stars = F.ceil(F.col("p_size") / 10).cast("int")
    tts = (seconds("l_shipdate") - seconds("o_orderdate")) * 1000
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100).cast("bigint")).alias("sale_id"), F.col("p_brand").alias("item"), stars.alias("stars"), k.base_key(F.col("p_brand"), stars, None, F.col("p_type")).alias("bk"),
        F.array(F.concat(F.lit("flag:"), "l_returnflag"), F.concat(F.lit("stat:"), "l_linestatus"), F.concat(F.lit("prio:"), F.substring("o_orderpriority", 1, 1))).alias("features"),
        F.col("l_extendedprice").alias("price"), seconds("l_shipdate").alias("sold_at"), F.when(F.col("l_suppkey") % 10 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("seller"),
        F.col("o_custkey").alias("buyer"), F.when(tts.between(0, 14 * DAY * 1000), tts).alias("tts_ms"), F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"), F.col("p_size").alias("size"),
    )


SALES = f"""sales AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100)::BIGINT) AS sale_id, p_brand AS item, ceil(p_size / 10)::INT AS stars,
        p_brand || CASE WHEN p_size > 0 THEN '*' || ceil(p_size / 10)::INT ELSE '' END || '~' || p_type AS bk, ['flag:' || l_returnflag, 'stat:' || l_linestatus, 'prio:' || o_orderpriority[1]] AS features,
        l_extendedprice AS price, epoch(l_shipdate)::DOUBLE AS sold_at, CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE l_suppkey::VARCHAR END AS seller, o_custkey AS buyer,
        CASE WHEN (epoch(l_shipdate) - epoch(o_orderdate)) * 1000 BETWEEN 0 AND {14 * DAY * 1000} THEN (epoch(l_shipdate) - epoch(o_orderdate))::DOUBLE * 1000 END AS tts_ms, l_orderkey AS order_id, l_quantity AS quantity, p_size AS size
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

#: Sales keyed by significant features as well (fk).
KEYED = f"""{SALES},
    base AS (SELECT bk, count(*) AS n, list_sort(list(price))[least(floor(0.20 * count(*))::INT + 1, count(*))] AS base_value, list_sort(list(price))[least(floor(0.95 * count(*))::INT + 1, count(*))] AS base_high FROM sales GROUP BY bk),
    feats AS (SELECT sale_id, bk, price, unnest(features) AS feature FROM sales),
    groups AS (SELECT bk, feature, count(*) AS n, median(price) AS median FROM feats GROUP BY bk, feature),
    sig AS (SELECT g.bk, g.feature, g.n, g.median FROM groups g JOIN base b USING (bk) WHERE g.median - b.base_value >= {CONFIG.min_share} * b.base_value AND g.n >= {CONFIG.min_samples}),
    tokens AS (SELECT f.sale_id, string_agg(DISTINCT f.feature, '+' ORDER BY f.feature) AS t FROM feats f JOIN sig USING (bk, feature) GROUP BY f.sale_id),
    keyed AS (SELECT s.*, s.bk || coalesce('#' || t, '') AS fk FROM sales s LEFT JOIN tokens USING (sale_id))"""


def floored(source: str, keys: str) -> str:
    """Each seller's cheapest sale of source."""
    return f"SELECT {keys}, min(price) AS price, arg_min(sold_at, (price, -sold_at)) AS sold_at FROM {source} GROUP BY {keys}, CASE WHEN seller = '' THEN '#/' || sale_id ELSE seller END"


#: Price statistics per fk.
STATS = f"""{KEYED},
    capped AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY fk ORDER BY sold_at DESC, sale_id DESC) <= {CONFIG.ref_cap}),
    floor_rows AS ({floored("capped", "fk")}),
    tops AS (SELECT fk, sum(c) AS raw, max(CASE WHEN seller <> '' THEN c ELSE 0 END) AS top FROM (SELECT fk, seller, count(*) AS c FROM capped GROUP BY fk, seller) GROUP BY fk),
    agg AS (
        SELECT fk, count(*) AS samples, median(price) AS long_term, count(*) FILTER (sold_at >= {NOW - CONFIG.short_hours * 3600}) AS n_recent, median(price) FILTER (sold_at >= {NOW - CONFIG.short_hours * 3600}) AS recent, stddev_pop(price) AS sd,
            list_sort(list(price)) AS prices, least(greatest((max(sold_at) - min(sold_at)) / 86400.0, 0.5), {CONFIG.max_age_days}) AS span, max(sold_at) AS last
        FROM floor_rows GROUP BY fk HAVING count(*) >= {CONFIG.min_refs}),
    parts AS (SELECT *, CASE WHEN n_recent >= 3 THEN recent ELSE long_term END AS short, least(sd / long_term, 1.0) AS volatility, samples / span AS volume_per_day, top / raw >= {CONFIG.manipulated_share} AS manipulated FROM agg JOIN tops USING (fk)),
    stats AS (
        SELECT fk, least(short, long_term) AS target, samples, volume_per_day, (prices[floor(0.75 * (len(prices) - 1))::INT + 1] - prices[floor(0.25 * (len(prices) - 1))::INT + 1]) / long_term AS spread_pct, prices[1] AS lowest_ref, prices[-1] AS highest_ref,
            greatest(({NOW} - last) / 3600.0, 0) AS last_sold_ago_h, (0.4 * least(samples / 12.0, 1) + 0.4 * greatest(1 - volatility, 0) + 0.2 * least(volume_per_day / 3.0, 1)) * CASE WHEN manipulated THEN 0.5 ELSE 1 END AS confidence,
            volatility, manipulated, CASE WHEN n_recent >= 3 THEN (short - long_term) / long_term ELSE 0 END AS trend_pct
        FROM parts)"""


def keyed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with fk. They are written once, since base values, feature tests and keys each read them, and so are the base
    values, a short list, so that the join knows how small it is."""
    from stallkeeper.operators import index

    own = materialised(sales(spark, sf_dir), "sales", large=True)
    base = materialised(index.base_stats(own).select("bk", "base_value"), "base")
    return index.with_final_key(own, index.feature_tests(own, base, CONFIG).where("learned"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live listings: the sales of returned items, at 45 percent of their price every seventh, with a sequence number."""
    return listings_of(keyed_sales(spark, sf_dir))


def listings_of(keyed: DataFrame) -> DataFrame:
    own = keyed.where(F.array_contains("features", "flag:R"))
    price = F.when(F.col("quantity") % 7 == 0, F.col("price") * 0.45).otherwise(F.col("price"))
    return own.select(F.col("sale_id").alias("uuid"), (F.col("order_id") * 8 + F.col("quantity")).alias("seq"), "item", "bk", "fk", "features", price.alias("price"), "seller")


LISTINGS = f"""{STATS},
    listings AS (SELECT sale_id AS uuid, order_id * 8 + quantity AS seq, item, bk, fk, features, CASE WHEN quantity % 7 = 0 THEN price * 0.45 ELSE price END AS price, seller FROM keyed WHERE list_contains(features, 'flag:R')),
    market AS (
        SELECT *, CASE WHEN rank = 1 THEN second ELSE first END AS lbin FROM (
            SELECT *, row_number() OVER w AS rank, first_value(price) OVER v AS first, nth_value(price, 2) OVER v AS second, last_value(price) OVER v AS dearest, count(*) OVER v AS depth FROM listings
            WINDOW w AS (PARTITION BY fk ORDER BY price, uuid), v AS (PARTITION BY fk ORDER BY price, uuid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per event type and half hour: ask and bid from the values."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("product"), (F.floor(seconds("ts") / 1800) * 1800).cast("double").alias("ts")).agg((F.max("value") + 1).alias("ask"), (F.min("value") + 0.5).alias("bid"))


SNAPSHOTS = "snapshots AS (SELECT event_type AS product, (floor(epoch(ts) / 1800) * 1800)::DOUBLE AS ts, max(value) + 1 AS ask, min(value) + 0.5 AS bid FROM events GROUP BY 1, 2)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book side per brand: levels of price and amount, cheapest first, one per price."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_retailprice").agg(F.sum("p_size").cast("double").alias("amount"))
    return p.groupBy(F.col("p_brand").alias("product")).agg(F.sort_array(F.collect_list(F.struct(F.col("p_retailprice").alias("price"), "amount"))).alias("levels"))


LEVELS = "levels AS (SELECT p_brand AS product, p_retailprice AS price, sum(p_size)::DOUBLE AS amount, sum(sum(p_size)) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS seen FROM part GROUP BY 1, 2)"
