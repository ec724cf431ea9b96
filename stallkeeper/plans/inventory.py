"""More of the engine's operators over the driver's tables: routes, gates, ledgers, windows; registered with the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stallkeeper.functions import keys as k
from stallkeeper.functions import orderstats as o
from stallkeeper.operators import book, filters, gates, index, lanes, ledger, positions
from stallkeeper.plans import views
from stallkeeper.plans.queries import _FLIPS, _POSTED, _flips, _posted, query, rounded
from stallkeeper.plans.views import CONFIG, DAY, KEYED, LISTINGS, NOW, SALES, SNAPSHOTS, floored, table
from stallkeeper.sources.tables import materialised

_ROWS = "rows AS (SELECT sale_id AS uuid, quantity % 3 <> 0 AS bin, CASE WHEN quantity % 11 = 0 THEN 0 ELSE price END AS price, CASE WHEN quantity % 7 = 0 THEN '' ELSE 'x' END AS item_bytes, order_id FROM sales)"


def _rows(spark, d):
    q = F.col("quantity")
    return views.sales(spark, d).select(F.col("sale_id").alias("uuid"), (q % 3 != 0).alias("bin"), F.when(q % 11 == 0, 0.0).otherwise(F.col("price")).alias("price"), F.when(q % 7 == 0, "").otherwise("x").alias("item_bytes"), "order_id")


# Sources and keys


@query("S10_clean_names", "SELECT p_partkey, trim(regexp_replace('§a' || p_name || '§r ', '§.', '', 'g')) AS name FROM part")
def s10(spark, d):
    return table(spark, d, "part").select("p_partkey", k.clean_name(F.concat(F.lit("§a"), "p_name", F.lit("§r "))).alias("name"))


@query("S16_sighting", f"WITH {SALES}, r AS (SELECT sale_id, item, floor(price / 1000)::BIGINT AS price, sold_at, seller FROM sales), s AS (SELECT item, price, arg_min(seller, (sold_at, sale_id)) AS seen_seller, min(sold_at) AS seen_at FROM r WHERE seller <> '' GROUP BY 1, 2) SELECT sale_id, seen_seller, seen_at FROM r LEFT JOIN s USING (item, price)")
def s16(spark, d):
    own = views.sales(spark, d).select("sale_id", "item", F.floor(F.col("price") / 1000).alias("price"), "sold_at", "seller")
    seen = own.where("seller <> ''").groupBy("item", "price").agg(F.min_by("seller", F.struct("sold_at", "sale_id")).alias("seller"), F.min("sold_at").alias("at"))
    return ledger.sighting(own.drop("seller"), seen).select("sale_id", "seen_seller", "seen_at")


@query("K5_record_posted", f"WITH {_POSTED} SELECT uuid, bk FROM posted WHERE sold_at IS NULL AND uuid NOT IN (SELECT uuid FROM posted WHERE item % 7 = 0)")
def k5(spark, d):
    own = _posted(spark, d)
    return ledger.record_first(own.where("item % 7 = 0"), own.where("sold_at is null"), ["uuid"], [F.col("posted_at")]).select("uuid", "bk")


@query("K6_insert_snapshot", f"WITH {SNAPSHOTS} SELECT product, ts, ask, bid FROM snapshots WHERE ts::BIGINT % 7200 <> 0")
def k6(spark, d):
    own = views.snapshots(spark, d)
    return ledger.record_first(own.where("cast(ts as bigint) % 7200 = 0"), own, ["product", "ts"], [F.col("ask")]).select("product", "ts", "ask", "bid")


@query("K8_bridge", "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_orderkey")
def k8(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ledger.record_first(known, table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_partkey")]).select("l_orderkey", "l_partkey")


@query("K10_ledger_record", f"WITH {SALES}, f AS (SELECT sale_id, price * quantity AS gross, price * 0.9 * quantity AS cost FROM sales) SELECT sale_id, gross * 0.0125 AS tax, gross * 0.9875 - cost AS net, round((gross * 0.9875 - cost) / cost, 6) AS roi FROM f")
def k10(spark, d):
    own = views.sales(spark, d).withColumns(ledger.fill_row(F.col("price") * 0.9, F.col("price"), F.col("quantity"), 0.0125))
    return own.select("sale_id", "tax", "net", F.round("roi", 6).alias("roi"))


@query("P3_always_splits", "SELECT p_partkey, (p_size % 4 = 0 OR p_size % 4 = 2) AS splits FROM part")
def p3(spark, d):
    token = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("skin:"), "p_brand")).when(F.col("p_size") % 4 == 1, "x:plain").when(F.col("p_size") % 4 == 2, "x:shiny").otherwise(F.concat(F.lit("reforge:"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", k.always_splits(token).alias("splits"))


@query("P11_lore_weight", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 1000 END::BIGINT AS weight FROM part")
def p11(spark, d):
    lore = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("§7Current weight: §a"), F.format_number(F.col("p_size") * 1000, 0), F.lit(" §8kg")))
    return table(spark, d, "part").select("p_partkey", k.lore_weight(lore).alias("weight"))


# Filters


@query("F1_fresh", f"WITH {SALES} SELECT sale_id FROM sales WHERE sold_at >= {NOW - CONFIG.max_age_days * DAY} AND price > 0")
def f1(spark, d):
    return index.fresh(views.sales(spark, d), NOW, CONFIG).select("sale_id")


@query("F2_usable_listings", f"WITH {SALES}, {_ROWS} SELECT uuid FROM rows WHERE bin AND price > 0 AND item_bytes <> ''")
def f2(spark, d):
    return gates.usable(_rows(spark, d)).select("uuid")


@query("F3_route", f"WITH {SALES}, {_ROWS} SELECT uuid, CASE WHEN NOT bin THEN 'skip' WHEN order_id % 2 = 0 THEN 'old' WHEN item_bytes <> '' THEN 'new' ELSE 'skip' END AS route FROM rows")
def f3(spark, d):
    own = _rows(spark, d)
    return gates.route(own, own.where("order_id % 2 = 0")).select("uuid", "route")


_PRICED = f"WITH {SALES}, priced AS (SELECT price, price * (order_id % 7) / 20 AS profit FROM sales)"


@query("F6_client_gates", f"{_PRICED}, c AS (SELECT c_custkey AS client, c_custkey % 9 AS free, c_custkey % 16 AS auctions, (c_acctbal + 1000) * 40 AS purse, c_custkey % 2 = 0 AS at_limit, c_custkey % 30 AS used FROM customer), j AS (SELECT *, CASE WHEN 8000 > s AND at_limit AND used >= 20 THEN true ELSE false END AS packed FROM (SELECT *, CASE WHEN purse > 200000 THEN purse * 0.02 ELSE 0 END AS s FROM priced, c)) SELECT client, coalesce(CASE WHEN free < 2 THEN 'slots' WHEN auctions >= 14 THEN 'auctions' WHEN purse > 0 AND price > purse * 0.5 THEN 'purse' WHEN packed AND profit < 8000 THEN 'full' WHEN s > 0 AND NOT packed AND profit < s THEN 'floor' END, 'passed') AS reason, count(*) AS n FROM j GROUP BY 1, 2")
def f6(spark, d):
    key = F.col("c_custkey")
    clients = table(spark, d, "customer").select(key.alias("client"), (key % 9).alias("free"), (key % 16).alias("auctions"), ((F.col("c_acctbal") + 1000) * 40).alias("purse"), (key % 2 == 0).alias("at_limit"), (key % 30).alias("used"))
    flips = views.sales(spark, d).select("price", (F.col("price") * F.pmod(F.col("order_id"), F.lit(7)) / 20).alias("profit"))  # dear ones needn't gain more
    return gates.client_reasons(flips, clients, 2, 14, 0.5, 0.02, 200000, 8000, 20)


@query("F7_base_decision", f"{_FLIPS} SELECT coalesce(CASE WHEN profit < 3000 THEN 'hard' WHEN item = 'Brand#11' THEN 'blacklist' WHEN NOT (roi >= 0.4) THEN 'tiers' END, 'passed') AS reason, count(*) AS n FROM flips GROUP BY 1")
def f7(spark, d):
    return filters.funnel(_flips(spark, d).withColumn("reason", gates.base_decision(3000, ["brand#11"], F.col("roi") >= 0.4)))


@query("F13_not_own", f"WITH {LISTINGS} SELECT uuid FROM listings WHERE seq % 5 <> 0 AND seller NOT IN (SELECT seller FROM listings WHERE seq % 97 = 0)")
def f13(spark, d):
    own = views.listings(spark, d).withColumnRenamed("seller", "item_uuid")
    return gates.not_own(own, own.where("seq % 5 = 0"), own.where("seq % 97 = 0")).select("uuid")


@query("F15_trade_messages", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'buy_placed' WHEN 1 THEN 'sell_filled' WHEN 2 THEN 'max_orders' END AS kind, CASE WHEN p_size % 4 < 3 THEN (p_size * 100)::DOUBLE END AS units, CASE WHEN p_size % 4 < 2 THEN p_brand END AS name, CASE WHEN p_size % 4 = 0 THEN (p_size * 70000)::DOUBLE END AS coins FROM part")
def f15(spark, d):
    units, kind = F.format_number(F.col("p_size") * 100, 0), F.col("p_size") % 4
    line = F.when(kind == 0, F.concat(F.lit("[Bazaar] Buy Order Setup! "), units, F.lit("x "), "p_brand", F.lit(" for "), F.format_number(F.col("p_size") * 70000, 0), F.lit(" coins."))).when(kind == 1, F.concat(F.lit("Your Sell Offer for "), units, F.lit("x  "), "p_brand", F.lit(" was filled!"))).when(kind == 2, F.concat(F.lit("You reached your maximum of "), units, F.lit(" orders"))).otherwise("hello")
    return table(spark, d, "part").select("p_partkey", gates.trade_message(line).alias("m")).select("p_partkey", "m.*")


# Joins


@query("J1_price_lookup", f"WITH {LISTINGS} SELECT uuid, target, samples FROM listings LEFT JOIN stats USING (fk)")
def j1(spark, d):
    own = views.keyed_sales(spark, d)
    stats = index.key_stats(own, NOW, CONFIG)
    return views.listings_of(own).join(stats.select("fk", "target", "samples"), "fk", "left").select("uuid", "target", "samples")


@query("J3_significant_tokens", f"WITH {KEYED} SELECT sale_id, count(*) AS n FROM feats JOIN sig USING (bk, feature) GROUP BY sale_id")
def j3(spark, d):
    own = views.sales(spark, d)
    sig = index.significant(index.feature_groups(own), index.base_stats(own), CONFIG)
    return own.select("sale_id", "bk", F.explode("features").alias("feature")).join(sig.select("bk", "feature"), ["bk", "feature"]).groupBy("sale_id").agg(F.count("*").alias("n"))


@query("J8_previous_book", f"WITH {LISTINGS}, prev AS (SELECT fk, min(price) AS was FROM listings WHERE seq % 2 = 0 GROUP BY fk) SELECT uuid, was FROM listings LEFT JOIN prev USING (fk) WHERE seq % 2 = 1")
def j8(spark, d):
    own = views.listings(spark, d)
    return own.where("seq % 2 = 1").join(own.where("seq % 2 = 0").groupBy("fk").agg(F.min("price").alias("was")), "fk", "left").select("uuid", "was")


@query("J12_gone", f"WITH {_POSTED} SELECT uuid FROM posted WHERE bought_at IS NOT NULL AND sold_at IS NULL AND bought_at < {NOW - 180} AND item_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def j12(spark, d):
    inventory = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item_id"))
    return ledger.gone(_posted(spark, d), inventory, NOW).select("uuid")


@query("J13_bought_variant", f"WITH {SALES} SELECT buyer AS item_id, regexp_extract(arg_max(bk, (sold_at, sale_id)), '~(.*)$', 1) AS variant FROM sales GROUP BY buyer")
def j13(spark, d):
    return ledger.bought_variant(views.sales(spark, d).select(F.col("buyer").alias("item_id"), "bk", F.col("sold_at").alias("posted_at"), F.col("sale_id").alias("uuid")))


@query("J16_best_orphan", "WITH h AS (SELECT l_suppkey AS owner, l_partkey AS product, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2), l AS (SELECT owner, product, units * p_retailprice AS worth FROM h JOIN part ON p_partkey = product WHERE (owner + product) % 3 <> 0) SELECT owner, arg_max(product, (worth, product)) AS product, max(worth) AS worth FROM l GROUP BY owner")
def j16(spark, d):
    holdings = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("product")).agg(F.sum("l_quantity").alias("units"))
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_retailprice").alias("price"))
    return ledger.best_orphan(holdings, holdings.where("(owner + product) % 3 = 0"), prices)


# Aggregates


@query("A4_star_significance", f"WITH {SALES}, s AS (SELECT *, regexp_replace(bk, '^([^*]*)\\*[0-9.]+', '\\1') AS bare FROM sales), b AS (SELECT bare, list_sort(list(price))[least(floor(0.20 * count(*))::INT + 1, count(*))] AS base_value FROM s GROUP BY bare), g AS (SELECT bare, stars, count(*) AS n, median(price) AS median FROM s WHERE stars > 0 GROUP BY 1, 2) SELECT bare, stars, n, median FROM g JOIN b USING (bare) WHERE n >= {CONFIG.min_samples} AND median - base_value >= {CONFIG.min_share} * base_value")
def a4(spark, d):
    return index.star_significance(views.sales(spark, d), CONFIG, k.strip_stars(F.col("bk"))).select("bare", "stars", "n", "median")


@query("A6_pools", f"WITH {KEYED} SELECT fk, count(*) AS n, max(sold_at) AS newest, min(price) AS cheapest FROM keyed GROUP BY fk")
def a6(spark, d):
    return views.keyed_sales(spark, d).groupBy("fk").agg(F.count("*").alias("n"), F.max("sold_at").alias("newest"), F.min("price").alias("cheapest"))


_HOURS = [24 * 1300, 24 * 1400, 24 * 2000]


@query("A10_widened_window", f"WITH {SALES}, r AS (SELECT bk, " + ", ".join(f"count(*) FILTER (sold_at >= {NOW - h * 3600}) AS n{i}, median(price) FILTER (sold_at >= {NOW - h * 3600}) AS m{i}" for i, h in enumerate(_HOURS)) + f" FROM sales WHERE sold_at >= {NOW - _HOURS[-1] * 3600} GROUP BY bk) SELECT bk, CASE WHEN n0 >= 3 THEN m0 WHEN n1 >= 3 THEN m1 ELSE m2 END AS median, CASE WHEN n0 >= 3 THEN n0 WHEN n1 >= 3 THEN n1 ELSE n2 END AS n FROM r")
def a10(spark, d):
    return index.widened(views.sales(spark, d), "bk", NOW, _HOURS, 3)


@query("A11_dispersion", f"WITH {SALES}, c AS (SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY bk ORDER BY sold_at DESC, sale_id DESC) <= {CONFIG.ref_cap}), g AS (SELECT bk, list_sort(list(price)) AS p, median(price) AS m, stddev_pop(price) AS sd FROM c GROUP BY bk) SELECT bk, round(least(sd / m, 1), 6) AS plain, round(least((p[floor(0.75 * (len(p) - 1))::INT + 1] - p[floor(0.25 * (len(p) - 1))::INT + 1]) / 1.349 / m, 1), 6) AS robust FROM g")
def a11(spark, d):
    capped = o.newest(views.sales(spark, d), ["bk"], ["sold_at", "sale_id"], CONFIG.ref_cap)
    own = capped.groupBy("bk").agg(o.sorted_list("price").alias("p"), F.median("price").alias("m"), F.stddev_pop("price").alias("sd"))
    spread = lambda robust: index.dispersion(F.col("p"), F.col("m"), F.col("sd"), robust)
    return rounded(own.select("bk", spread(False).alias("plain"), spread(True).alias("robust")), "plain", "robust")


@query("A19_binding_floor", f"WITH {LISTINGS}, l AS (SELECT uuid, listings.bk, unnest(listings.features) AS feature, target FROM listings JOIN stats USING (fk)) SELECT uuid, min(median) AS floor FROM l JOIN groups USING (bk, feature) WHERE median < target * (1 - 0.1) GROUP BY uuid")
def a19(spark, d):
    own = views.keyed_sales(spark, d)
    stats = materialised(index.key_stats(own, NOW, CONFIG).select("fk", "target"), "stats")
    groups = materialised(index.feature_groups(own), "groups")
    return index.binding_feature_floor(views.listings_of(own).join(stats, "fk"), groups, 0.1)


@query("A26_funnel", f"WITH {SALES}, {_ROWS} SELECT CASE WHEN NOT bin THEN 'bids' WHEN price <= 0 THEN 'price' WHEN item_bytes = '' THEN 'bytes' ELSE 'passed' END AS reason, count(*) AS n FROM rows GROUP BY 1")
def a26(spark, d):
    reason = filters.first_reason((~F.col("bin"), "bids"), (F.col("price") <= 0, "price"), (F.col("item_bytes") == "", "bytes"))
    return filters.funnel(_rows(spark, d).withColumn("reason", reason))


# Windows and sets


@query("W1_newest_of_key", f"WITH {SALES} SELECT sale_id FROM sales QUALIFY row_number() OVER (PARTITION BY bk ORDER BY sold_at DESC, sale_id DESC) <= 12")
def w1(spark, d):
    return o.newest(views.sales(spark, d), ["bk"], ["sold_at", "sale_id"], 12).select("sale_id")


@query("W2_seller_floor", f"WITH {SALES}, f AS ({floored('sales', 'bk')}) SELECT bk, count(*) AS n, round(sum(price), 2) AS total, min(sold_at) AS first FROM f GROUP BY bk")
def w2(spark, d):
    return o.seller_floor(views.sales(spark, d), ["bk"], ["sale_id"]).groupBy("bk").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.min("sold_at").alias("first"))


@query("W3_bid_rises", f"WITH {SNAPSHOTS}, r AS (SELECT product, bid > lag(bid) OVER (PARTITION BY product ORDER BY ts) AS up FROM snapshots) SELECT product, count(*) FILTER (up) AS rises FROM r GROUP BY product")
def w3(spark, d):
    up = F.col("bid") > F.lag("bid").over(Window.partitionBy("product").orderBy("ts"))
    return views.snapshots(spark, d).withColumn("up", up).groupBy("product").agg(F.count(F.when(F.col("up"), 1)).alias("rises"))


@query("W9_second_cheapest", f"WITH {LISTINGS} SELECT uuid, price, second FROM market WHERE rank = 1 AND second IS NOT NULL")
def w9(spark, d):
    return lanes.with_market(views.listings(spark, d)).where("rank = 1 and second is not null").select("uuid", "price", "second")


@query("W10_relist_rank", f"WITH {LISTINGS} SELECT uuid FROM listings WHERE seller <> '' QUALIFY row_number() OVER (PARTITION BY seller, fk ORDER BY seq, uuid) <= 3")
def w10(spark, d):
    return views.listings(spark, d).where("seller <> ''").withColumn("r", index.rank_of(["seller", "fk"], [F.col("seq"), F.col("uuid")])).where("r <= 3").select("uuid")


@query("U3_first_page", "SELECT l_partkey, min(l_orderkey) AS page FROM lineitem GROUP BY l_partkey")
def u3(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("page"))


@query("U4_retain_live", f"WITH {SALES} SELECT sale_id FROM sales WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def u4(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"))
    return views.sales(spark, d).join(live, "order_id", "left_semi").select("sale_id")


@query("U6_multiset_subset", "WITH t AS (SELECT p_partkey, ['a', 'b'] || CASE WHEN p_size % 2 = 0 THEN ['a'] ELSE ['c'] END AS have FROM part) SELECT p_partkey, len(list_filter(have, lambda x: x = 'a')) >= 2 AS fits FROM t")
def u6(spark, d):
    have = F.concat(F.array(F.lit("a"), F.lit("b")), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("c"))))
    return table(spark, d, "part").select("p_partkey", o.multiset_contains(have, F.array(F.lit("a"), F.lit("a"))).alias("fits"))


# Positions: the orders, each in a brand's book of the parts' prices.

_STALE = positions.Stale(abandon_min=60 * 24 * 2300, reprice_min=60 * 24 * 400, keep_hours=2, stale_gap=0.2, requote_min=60 * 24 * 900, requote_gap=0.05)
_POS = f"""pos AS (SELECT o_orderkey AS id, 'Brand#' || (1 + o_custkey % 5) || (1 + (o_custkey // 5) % 5) AS product, o_custkey % 4 AS owner, epoch(o_orderdate)::DOUBLE * 1000 AS placed_ms, 900 + o_orderkey % 1200 AS buy_price, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::DOUBLE * 1000 END AS offered_ms,
    CASE WHEN o_orderkey % 9 > 0 THEN 1000 + o_custkey % 1100 END::DOUBLE AS ask, o_orderkey % 5 AS repriced, o_orderkey % 7 = 0 AS orphan, (o_orderkey % 40)::DOUBLE AS baseline FROM orders),
    bids AS (SELECT p_brand AS product, p_retailprice AS price, sum(p_size)::DOUBLE AS amount FROM part GROUP BY 1, 2), book AS (SELECT product, max(price) AS best_bid, min(price) + 50 AS best_ask, sum(amount) * 9 AS weekly FROM bids GROUP BY product)"""


def _positions(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    placed = views.seconds("o_orderdate") * 1000
    return table(spark, d, "orders").select(
        key.alias("id"), F.concat(F.lit("Brand#"), 1 + cust % 5, 1 + F.floor(cust / 5) % 5).alias("product"), (cust % 4).alias("owner"), placed.alias("placed_ms"), (900 + key % 1200).alias("buy_price"), F.when(F.col("o_orderstatus") == "F", placed).alias("offered_ms"),
        F.when(key % 9 > 0, (1000 + cust % 1100).cast("double")).alias("ask"), (key % 5).alias("repriced"), (key % 7 == 0).alias("orphan"), (key % 40).cast("double").alias("baseline"),
    )


def _market(spark, d):
    top = F.reverse(F.col("levels"))
    amount = F.aggregate("levels", F.lit(0.0), lambda a, x: a + x["amount"])
    return views.levels(spark, d).select("product", top.alias("bids"), (amount * 9).alias("weekly"), F.get(top, F.lit(0))["price"].alias("best_bid"), (F.get("levels", F.lit(0))["price"] + 50).alias("best_ask"))


@query("F12_stale_buys", f"""WITH {_POS}, aged AS (SELECT *, ({NOW} * 1000.0 - placed_ms) / 60000 AS age FROM pos LEFT JOIN book USING (product) WHERE offered_ms IS NULL),
    told AS (SELECT id, CASE WHEN age > {_STALE.abandon_min} THEN 'abandoned' WHEN age >= {_STALE.reprice_min} AND best_bid > buy_price AND NOT ((best_bid - buy_price) / buy_price <= {_STALE.stale_gap} AND weekly > 0 AND coalesce((SELECT sum(amount) FROM bids b WHERE b.product = aged.product AND b.price > buy_price), 0) <= weekly / 168.0 * {_STALE.keep_hours}) THEN 'outbid' END AS reason FROM aged)
    SELECT id, reason FROM told WHERE reason IS NOT NULL""")  # fmt: skip
def f12_buys(spark, d):
    return positions.stale_buys(_positions(spark, d), _market(spark, d), NOW * 1000.0, _STALE).select("id", "reason")


@query("F12_stale_sells", f"""WITH {_POS}, j AS (SELECT *, (ceil(best_ask * 10) - 1) / 10 AS front FROM pos JOIN book USING (product) WHERE offered_ms IS NOT NULL AND ask IS NOT NULL)
    SELECT id, front FROM j WHERE repriced < {_STALE.requotes} AND ({NOW} * 1000.0 - offered_ms) / 60000 >= {_STALE.requote_min} AND front < ask * {1 - _STALE.requote_gap} AND (orphan OR front >= buy_price / {1 - _STALE.tax})""")  # fmt: skip
def f12_sells(spark, d):
    return positions.stale_sells(_positions(spark, d), _market(spark, d), NOW * 1000.0, _STALE).select("id", "front")


_HELD = "held AS (SELECT s_suppkey % 4 AS owner, 'Brand#' || (1 + s_suppkey % 5) || (1 + (s_suppkey // 5) % 5) AS product, sum(floor(s_acctbal / 100))::DOUBLE AS units FROM supplier GROUP BY 1, 2)"


@query("J15_positions_and_stock", f"WITH {_POS}, {_HELD}, most AS (SELECT product, arg_max(owner, (units, owner)) AS holder FROM held WHERE units >= 1 GROUP BY product) SELECT id, best_bid, best_ask, holder, greatest(coalesce(units, 0) - baseline, 0) AS own_units FROM pos LEFT JOIN book USING (product) LEFT JOIN held USING (owner, product) LEFT JOIN most USING (product)")
def j15(spark, d):
    key = F.col("s_suppkey")
    held = table(spark, d, "supplier").select((key % 4).alias("owner"), F.concat(F.lit("Brand#"), 1 + key % 5, 1 + F.floor(key / 5) % 5).alias("product"), F.floor(F.col("s_acctbal") / 100).cast("double").alias("units"))
    return positions.with_stock(_positions(spark, d), _market(spark, d), held).select("id", "best_bid", "best_ask", "holder", "own_units")


# Prices that moved from their own median.


@query("price_moves", f"""WITH {SNAPSHOTS}, b AS (SELECT s.product, s.ts, s.ask, s.bid, median(p.ask) AS ask_median, median(p.bid) AS bid_median FROM snapshots s LEFT JOIN snapshots p ON p.product = s.product AND p.ts >= s.ts - 14400 AND p.ts < s.ts GROUP BY ALL)
    SELECT product, ts, round(greatest(CASE WHEN ask_median > 0 THEN abs(ask - ask_median) / ask_median * 100 ELSE 0 END, CASE WHEN bid_median > 0 THEN abs(bid - bid_median) / bid_median * 100 ELSE 0 END), 6) AS moved_pct FROM b""")  # fmt: skip
def price_moves(spark, d):
    return book.moved(views.snapshots(spark, d), 4 * 3600).select("product", "ts", F.round("moved_pct", 6).alias("moved_pct"))
