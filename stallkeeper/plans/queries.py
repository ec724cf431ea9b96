"""The engine's operators over the driver's tables, and their SQL. Derived ratios are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.config import Book, Lanes
from stallkeeper.functions import keys as k
from stallkeeper.functions import orderstats as o
from stallkeeper.functions import valuation as v
from stallkeeper.operators import book, filters, index, lanes, ledger, model, survival
from stallkeeper.plans import views
from stallkeeper.sources.tables import materialised
from stallkeeper.plans.views import CONFIG, DAY, KEYED, LEVELS, LISTINGS, NOW, SALES, SNAPSHOTS, STATS, floored, table

Query = Callable[[SparkSession, str], DataFrame]
RARE = replace(CONFIG, min_refs=2)  # pools that their own keys are too rare for
LANES = Lanes(min_profit=1000, snipe_margin=0.2, min_margin=0.12)
BOOK = Book(min_samples=20, min_margin_pct=3)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Sources and sinks


@query("S1_load_references", f"WITH {SALES} SELECT sale_id, price, sold_at, seller FROM sales WHERE sold_at >= {NOW - 1500 * DAY} AND price > 0")
def s1(spark, d):
    own = views.sales(spark, d)
    return own.where((F.col("sold_at") >= NOW - 1500 * DAY) & (F.col("price") > 0)).select("sale_id", "price", "sold_at", "seller")


@query("S2_censored_hours", f"SELECT o_orderpriority AS item, count(*) AS n, round(sum(({NOW} - epoch(o_orderdate)) / 3600.0), 6) AS hours FROM orders WHERE o_orderstatus = 'P' AND epoch(o_orderdate) <= {NOW} GROUP BY 1")
def s2(spark, d):
    hours = (F.lit(NOW) - views.seconds("o_orderdate")) / 3600.0
    own = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("item"), hours.alias("h")).where("h >= 0")
    return own.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("h"), 6).alias("hours"))


@query("S3_newest_sales", f"WITH {SALES} SELECT sale_id, sold_at FROM sales ORDER BY sold_at DESC, sale_id DESC LIMIT 500")
def s3(spark, d):
    return index.newest_sales(views.sales(spark, d), 500).select("sale_id", "sold_at")


@query("S8_product_prices", f"WITH {SNAPSHOTS}, l AS (SELECT product, arg_max(bid, ts) AS sell, arg_max(ask, ts) AS buy FROM snapshots GROUP BY product) SELECT product, CASE WHEN sell > 60 THEN sell ELSE buy END AS price FROM l")
def s8(spark, d):
    last = views.snapshots(spark, d).groupBy("product").agg(F.max_by("bid", "ts").alias("sell"), F.max_by("ask", "ts").alias("buy"))
    return last.select("product", F.when(F.col("sell") > 60, F.col("sell")).otherwise(F.col("buy")).alias("price"))


@query("S15_json_fields", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, length(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)::VARCHAR)::INT AS digits FROM events")
def s15(spark, d):
    n = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return table(spark, d, "events").select("event_id", n.alias("k"), k.digits_band(F.coalesce(n, F.lit(0))).alias("digits"))


_K1 = f"""WITH {SALES}, listing AS (SELECT o_orderkey AS order_id, epoch(o_orderdate) * 1000 AS start FROM orders WHERE o_orderstatus <> 'O'), known AS (SELECT sale_id FROM sales WHERE quantity > 40)
    SELECT s.sale_id, CASE WHEN s.sold_at * 1000 - start BETWEEN 0 AND {ledger.TTS_MOST_MS} THEN s.sold_at * 1000 - start END AS tts_ms FROM (SELECT DISTINCT sale_id, order_id, sold_at FROM sales) s LEFT JOIN listing USING (order_id) WHERE s.sale_id NOT IN (SELECT sale_id FROM known)"""


@query("K1_insert_sold", _K1)
def k1(spark, d):
    own = materialised(views.sales(spark, d).select("sale_id", "order_id", "sold_at", "quantity"), "sales")
    tasks = ledger.tasks_for(own.count())
    orders = table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("order_id"), (views.seconds("o_orderdate") * 1000).alias("start"))
    listed = own.select("sale_id", "order_id").repartition(tasks, "sale_id").distinct().join(orders, "order_id").select("sale_id", "start")
    return ledger.insert_sold(own.where("quantity > 40"), own.select("sale_id", "sold_at"), listed, tasks)[0].select("sale_id", "tts_ms")


@query("K2_record_listings", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def k2(spark, d):
    own = table(spark, d, "orders")
    return ledger.record_first(own.where("o_orderstatus = 'P'"), own, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("K3_prune_listings", f"SELECT o_orderkey, (({NOW} - epoch(o_orderdate)) * 1000)::DOUBLE AS lifetime_ms FROM orders WHERE o_orderstatus = 'O' AND epoch(o_orderdate) < {NOW - 1200 * DAY}")
def k3(spark, d):
    own = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", views.seconds("o_orderdate").alias("first_seen"), (views.seconds("o_orderdate") * 1000).alias("start"))
    return ledger.split_stale(own, NOW - 1200 * DAY, NOW * 1000.0)[1].select("o_orderkey", "lifetime_ms")


@query("K4_prune_old", f"WITH {SNAPSHOTS} SELECT product, count(*) AS n FROM snapshots WHERE ts >= (SELECT max(ts) FROM snapshots) - {7 * DAY} GROUP BY product")
def k4(spark, d):
    own = views.snapshots(spark, d)
    last = own.agg(F.max("ts").alias("last"))  # one row, without snapshots null
    return own.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - 7 * DAY).groupBy("product").agg(F.count("*").alias("n"))


@query("K7_first_sightings", f"WITH {SALES} SELECT item, floor(price / 1000)::BIGINT AS price, min(sold_at) AS at, arg_min(sale_id, (sold_at, sale_id)) AS sale_id FROM sales GROUP BY 1, 2")
def k7(spark, d):
    own = views.sales(spark, d)
    return own.groupBy("item", F.floor(F.col("price") / 1000).alias("price")).agg(F.min("sold_at").alias("at"), F.min_by("sale_id", F.struct("sold_at", "sale_id")).alias("sale_id"))


@query("K9_recent_ring", f"WITH {SALES} SELECT sale_id FROM sales WHERE sold_at >= {NOW - 900 * DAY} ORDER BY sold_at DESC, sale_id LIMIT 500")
def k9(spark, d):
    return ledger.ring(views.sales(spark, d), "sold_at", NOW - 900 * DAY, 500, "sale_id").select("sale_id")


@query("K13_cost_basis", f"WITH {SALES} SELECT buyer, max(sold_at) AS sold_at, arg_max(price, (sold_at, price)) AS price FROM sales GROUP BY buyer")
def k13(spark, d):
    return ledger.last_write(views.sales(spark, d), "buyer", "price", "sold_at")


# Keys


@query("P1_base_key", f"WITH {SALES} SELECT bk, count(*) AS n FROM sales GROUP BY bk")
def p1(spark, d):
    return views.sales(spark, d).groupBy("bk").agg(F.count("*").alias("n"))


@query("P4_final_key", f"WITH {KEYED} SELECT sale_id, fk FROM keyed")
def p4(spark, d):
    return views.keyed_sales(spark, d).select("sale_id", "fk")


@query("P6_strip_stars", f"WITH {SALES} SELECT DISTINCT bk, regexp_replace(bk, '^([^*]*)\\*[0-9.]+', '\\1') AS bare FROM sales")
def p6(spark, d):
    return views.sales(spark, d).select("bk", k.strip_stars(F.col("bk")).alias("bare")).distinct()


@query("P7_adjusted_price", f"WITH {SALES} SELECT sale_id, greatest(price - quantity * 600, price * 0.5) AS adjusted FROM sales")
def p7(spark, d):
    return views.sales(spark, d).select("sale_id", v.adjusted_price(F.col("price"), F.col("quantity") * 600).alias("adjusted"))


_COSTS = [float(100 + 7 * i * i) for i in range(99)]
_LEVEL = "1 + " + " + ".join(f"(x >= {sum(_COSTS[: i + 1])})::INT" for i in range(99))


@query("P8_level_bands", f"WITH t AS (SELECT c_custkey, least({_LEVEL}, 100) AS level FROM (SELECT c_custkey, (c_acctbal + 1000) * 200 AS x FROM customer)) SELECT c_custkey, level::INT AS level, CASE WHEN level >= 100 THEN 'max' WHEN level >= 90 THEN 'l90' WHEN level >= 50 THEN 'l50' ELSE 'l1' END AS band FROM t")
def p8(spark, d):
    own = table(spark, d, "customer").select("c_custkey", k.level_of((F.col("c_acctbal") + 1000) * 200, _COSTS, 100).alias("level"))
    return own.withColumn("band", k.level_band(F.col("level"), 100))


@query("P10_bands", "SELECT o_orderkey, least(floor(o_totalprice / 50000), 10)::INT AS bid, length(floor(o_totalprice)::BIGINT::VARCHAR)::INT AS digits, CASE WHEN o_totalprice >= 1 THEN floor(log10(o_totalprice))::INT ELSE 0 END AS magnitude, ((o_totalprice >= 15000)::INT + (o_totalprice >= 100000)::INT + (o_totalprice >= 300000)::INT) AS pulse FROM orders")
def p10(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", k.bid_band(x, 10, 50000).alias("bid"), k.digits_band(x).alias("digits"), k.magnitude_band(x).alias("magnitude"), k.ladder_band(x, [15000, 100000, 300000]).alias("pulse"))


@query("P14_ticks", "SELECT event_id, (floor(value * 10) + 1) / 10 AS up, (ceil(value * 10) - 1) / 10 AS down FROM events")
def p14(spark, d):
    return table(spark, d, "events").select("event_id", k.tick_up(F.col("value")).alias("up"), k.tick_down(F.col("value")).alias("down"))


# Aggregates


@query("A1_base_stats", f"WITH {KEYED} SELECT bk, n, base_value, base_high FROM base")
def a1(spark, d):
    return index.base_stats(views.sales(spark, d)).select("bk", "n", "base_value", "base_high")


@query("A2_feature_groups", f"WITH {KEYED} SELECT bk, feature, n, median FROM groups")
def a2(spark, d):
    return index.feature_groups(views.sales(spark, d))


@query("A3_significant_features", f"WITH {KEYED} SELECT bk, feature, n, median FROM sig")
def a3(spark, d):
    own = views.sales(spark, d)
    return index.significant(index.feature_groups(own), index.base_stats(own), CONFIG).select("bk", "feature", "n", "median")


@query("A5_signatures", f"WITH {KEYED} SELECT bk, string_agg(DISTINCT feature, ';' ORDER BY feature) AS signature FROM sig GROUP BY bk")
def a5(spark, d):
    own = views.sales(spark, d)
    return index.signatures(index.significant(index.feature_groups(own), index.base_stats(own), CONFIG))


@query("A7_fair_tts", f"WITH {KEYED}, m AS (SELECT fk, median(price) AS med FROM keyed GROUP BY fk), f AS (SELECT fk, median(tts_ms) FILTER (price BETWEEN med * 0.85 AND med * 1.15) / 3600000 AS h, count(*) FILTER (price BETWEEN med * 0.85 AND med * 1.15) AS n_fair, count(*) AS n_all FROM keyed JOIN m USING (fk) WHERE tts_ms IS NOT NULL AND med > 0 GROUP BY fk) SELECT fk, round(h, 6) AS fair_tts_h, n_fair, n_all FROM f WHERE n_fair > 0")
def a7(spark, d):
    return rounded(index.fair_time_to_sell(views.keyed_sales(spark, d)), "fair_tts_h")


_CLEAN = f"""bare AS (SELECT * FROM keyed WHERE fk = bk AND bk IN (SELECT bk FROM keyed WHERE fk = bk GROUP BY bk HAVING count(*) >= {CONFIG.min_refs})),
    clean AS (SELECT bk, median(price) AS clean, count(*) AS n, count(*) / least(greatest((max(sold_at) - min(sold_at)) / 86400.0, 0.5), {CONFIG.max_age_days}) AS volume_per_day FROM ({floored("bare", "bk")}) GROUP BY bk HAVING count(*) >= {CONFIG.min_refs})"""


@query("A8_clean_values", f"WITH {KEYED}, {_CLEAN} SELECT bk, clean, n, round(volume_per_day, 6) AS volume_per_day FROM clean")
def a8(spark, d):
    return rounded(index.clean_values(views.keyed_sales(spark, d), CONFIG), "volume_per_day")


_STAT_COLUMNS = ("volume_per_day", "spread_pct", "last_sold_ago_h", "confidence", "volatility", "trend_pct")


@query("A9_key_stats", f"WITH {STATS} SELECT fk, target, samples, {', '.join(f'round({c}, 6) AS {c}' for c in _STAT_COLUMNS)}, lowest_ref, highest_ref, manipulated FROM stats")
def a9(spark, d):
    return rounded(index.key_stats(views.keyed_sales(spark, d), NOW, CONFIG), *_STAT_COLUMNS)


@query("A12_top_seller_share", f"WITH {KEYED}, n AS (SELECT fk, count(*) AS n FROM keyed GROUP BY fk), s AS (SELECT fk, seller, count(*) AS c FROM keyed WHERE seller <> '' GROUP BY 1, 2) SELECT fk, round(max(c) / any_value(n), 6) AS share FROM s JOIN n USING (fk) GROUP BY fk")
def a12(spark, d):
    return rounded(index.manipulated_share(views.keyed_sales(spark, d)), "share")


_HOURS = [24 * 400.0, 24 * 800.0, 24 * 2000.0]
_RUNGS = ", ".join(f"CASE WHEN count(*) FILTER (sold_at >= {NOW - h * 3600}) >= 5 THEN median(price) FILTER (sold_at >= {NOW - h * 3600}) END" for h in _HOURS)


@query("A13_base_trend", f"WITH {KEYED}, p AS (SELECT * FROM keyed WHERE fk = bk), w AS (SELECT bk, median(price) AS a, count(*) AS n FROM p GROUP BY bk), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY bk ORDER BY sold_at DESC, sale_id DESC) <= 200), r AS (SELECT bk, coalesce({_RUNGS}) AS recent FROM t GROUP BY bk) SELECT bk, round(CASE WHEN n >= {CONFIG.min_refs} AND recent IS NOT NULL THEN (recent - a) / a ELSE 0 END, 6) AS trend_pct FROM w JOIN r USING (bk)")
def a13(spark, d):
    return rounded(index.base_trend(views.keyed_sales(spark, d), NOW, _HOURS, CONFIG), "trend_pct")


@query("A14_cheap_median", f"WITH {KEYED} SELECT fk, median(price) AS median, count(*) AS n FROM keyed GROUP BY fk HAVING count(*) >= 3")
def a14(spark, d):
    return index.cheap_median(views.keyed_sales(spark, d))


@query("A15_thin_evidence", f"WITH {KEYED}, t AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY fk ORDER BY sold_at DESC, sale_id DESC) <= 12) SELECT fk, median(t.price) AS median, any_value(n) AS n FROM t JOIN (SELECT fk, count(*) AS n FROM keyed GROUP BY fk) USING (fk) GROUP BY fk")
def a15(spark, d):
    return index.thin_evidence(views.keyed_sales(spark, d))


@query("A16_base_volume", f"WITH {SALES} SELECT bk, round(count(*) / least(greatest((max(sold_at) - min(sold_at)) / 86400.0, 0.5), {CONFIG.max_age_days}), 6) AS volume_per_day FROM sales GROUP BY bk")
def a16(spark, d):
    return rounded(index.base_volume(views.sales(spark, d), CONFIG), "volume_per_day")


_DOMINANCE = f"""refs AS (SELECT bk, price, sold_at, seller, sale_id, features AS theirs FROM keyed QUALIFY row_number() OVER (PARTITION BY bk ORDER BY sold_at DESC, sale_id DESC) <= {CONFIG.dominance_rows}),
    pool AS (SELECT l.uuid, r.* FROM listings l JOIN refs r ON r.bk = l.bk AND len(list_filter(list_distinct(r.theirs), lambda x: len(list_filter(r.theirs, lambda y: y = x)) > len(list_filter(l.features, lambda y: y = x)))) = 0),
    dom AS (SELECT uuid, median(price) AS target, count(*) AS samples, count(*) / least(greatest((max(sold_at) - min(sold_at)) / 86400.0, 0.5), {CONFIG.max_age_days}) AS volume_per_day FROM ({floored("pool", "uuid")}) GROUP BY uuid HAVING count(*) >= {RARE.min_refs}),
    domshare AS (SELECT uuid, max(CASE WHEN seller <> '' THEN c ELSE 0 END) / sum(c) >= {CONFIG.manipulated_share} AS manipulated FROM (SELECT uuid, seller, count(*) AS c FROM pool GROUP BY 1, 2) GROUP BY uuid)"""


@query("A17_dominance_floor", f"WITH {LISTINGS}, {_DOMINANCE} SELECT uuid, target, samples, round(volume_per_day, 6) AS volume_per_day, manipulated FROM dom JOIN domshare USING (uuid)")
def a17(spark, d):
    keyed = materialised(views.keyed_sales(spark, d), "keyed")
    return rounded(index.dominance_floor(views.listings_of(keyed), keyed, RARE), "volume_per_day")


_KM = f"""obs AS (SELECT item, tts_ms / 3600000 AS t, 1 AS d FROM sales WHERE tts_ms IS NOT NULL UNION ALL SELECT item, 24.0 * (1 + quantity % 14) AS t, 0 FROM sales WHERE tts_ms IS NULL AND quantity > 25),
    steps AS (SELECT item, t, sum(d) AS sold, count(*) AS leaving FROM obs GROUP BY 1, 2),
    risk AS (SELECT item, t, sold, sum(leaving) OVER (PARTITION BY item ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM steps),
    curve AS (SELECT item, t, at_risk, sold, CASE WHEN min(1 - sold / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(ln(greatest(1 - sold / at_risk, 1e-300))) OVER w) END AS survival FROM risk WINDOW w AS (PARTITION BY item ORDER BY t))"""


def _curve(own):
    lost = own.where("tts_ms is null and quantity > 25").select("item", (24.0 * (1 + F.col("quantity") % 14)).alias("t"))
    return survival.curve(own.where("tts_ms is not null").select("item", (F.col("tts_ms") / 3_600_000).alias("t")), lost)


@query("A18_kaplan_meier", f"WITH {SALES}, {_KM} SELECT item, t, at_risk::BIGINT AS at_risk, sold::BIGINT AS sold, round(survival, 6) AS survival FROM curve")
def a18(spark, d):
    return rounded(_curve(views.sales(spark, d)), "survival")


@query("A18_sell_through", f"WITH {SALES}, {_KM} SELECT item, round(1 - coalesce(min(survival) FILTER (t <= 120), 1), 6) AS sell_through, min(t) FILTER (survival <= 0.5 + 1e-9) AS median_t FROM curve GROUP BY item")
def a18b(spark, d):
    curves = _curve(views.sales(spark, d)).withColumn("survival", F.col("survival") - 1e-9)
    return survival.sell_through(curves, 120).withColumn("sell_through", F.round(F.col("sell_through") - 1e-9, 6)).join(survival.median_time(curves), "item")


_MODEL = f"""combos AS (SELECT bk, combo, count(*) AS n, median(price) AS median FROM ({floored("(SELECT *, array_to_string(list_sort(features[:2]), '+') AS combo FROM sales WHERE quantity > 5 UNION ALL SELECT *, CASE WHEN quantity > 2 THEN features[1] ELSE '' END FROM sales WHERE quantity <= 5)", "bk, combo")}) GROUP BY 1, 2),
    withs AS (SELECT bk, n, median, unnest(string_split(combo, '+')) AS feature, string_split(combo, '+') AS f FROM combos WHERE combo <> ''),
    pairs AS (SELECT w.bk, w.feature, w.median - o.median AS diff, least(w.n, o.n) AS n FROM withs w JOIN combos o ON o.bk = w.bk AND o.combo = array_to_string(list_filter(w.f, lambda x: x <> w.feature), '+')),
    fv AS (SELECT bk, feature, sum(n) * median(diff) / (sum(n) + {CONFIG.prior}) AS value, sum(n) AS count FROM pairs GROUP BY 1, 2),
    anchors AS (SELECT bk, min((median, -n, combo)) AS a FROM combos WHERE combo <> '' AND n >= {CONFIG.min_refs} AND median > 0 GROUP BY bk),
    bares AS (SELECT bk, median AS bare FROM combos WHERE combo = '' AND n >= {CONFIG.min_refs}),
    bl AS (SELECT bk, coalesce(bare, a[1]) AS baseline, CASE WHEN bare IS NOT NULL THEN '' ELSE a[3] END AS anchor FROM anchors FULL JOIN bares USING (bk)),
    many AS (SELECT bk, combo, n, median, baseline, list_filter(string_split(combo, '+'), lambda x: x <> '') AS f, list_filter(string_split(anchor, '+'), lambda x: x <> '') AS a FROM combos JOIN bl USING (bk) WHERE n >= 5 AND contains(combo, '+')),
    moves AS (SELECT bk, combo, unnest(list_filter(f, lambda x: NOT list_contains(a, x))) AS feature, 1 AS sign FROM many UNION ALL SELECT bk, combo, unnest(list_filter(a, lambda x: NOT list_contains(f, x))), -1 FROM many),
    moved AS (SELECT bk, combo, sum(sign * greatest(value, 0)) AS moved FROM moves JOIN fv USING (bk, feature) GROUP BY 1, 2),
    fixes AS (SELECT bk, combo, least(greatest((median - baseline - coalesce(moved, 0)) * n / (n + {CONFIG.prior}), median * -0.5), median * 0.5) AS correction FROM many LEFT JOIN moved USING (bk, combo))"""


def _combos(spark, d):
    return _combos_of(views.sales(spark, d))


def _combos_of(own):
    none = F.array().cast("array<string>")
    feats = F.when(F.col("quantity") > 5, F.slice("features", 1, 2)).when(F.col("quantity") > 2, F.slice("features", 1, 1)).otherwise(none)
    return model.combos(own.withColumn("features", feats))


@query("A20_feature_values", f"WITH {SALES}, {_MODEL} SELECT bk, feature, round(value, 6) AS value, count::BIGINT AS count FROM fv")
def a20(spark, d):
    return rounded(model.feature_values(_combos(spark, d), CONFIG), "value")


@query("A20_corrections", f"WITH {SALES}, {_MODEL} SELECT bk, combo, round(correction, 9) AS correction FROM fixes")
def a20b(spark, d):
    stats = _combos(spark, d)
    return model.corrections(stats, model.feature_values(stats, CONFIG), model.baselines(stats, CONFIG), CONFIG).withColumn("correction", F.round("correction", 9))


@query("A20_baselines", f"WITH {SALES}, {_MODEL} SELECT bk, baseline, anchor FROM bl")
def a20c(spark, d):
    return model.baselines(_combos(spark, d), CONFIG)


@query("A21_band_volume", f"WITH {SALES}, asks AS (SELECT sale_id AS id, bk, price AS ask FROM sales WHERE quantity = 1), s AS (SELECT bk, least(greatest((max(sold_at) - min(sold_at)) / 86400.0, 0.5), {CONFIG.max_age_days}) AS span FROM sales GROUP BY bk) SELECT id, round(count(*) / any_value(span), 6) AS per_day FROM asks JOIN s USING (bk) JOIN sales x ON x.bk = asks.bk AND x.price >= ask GROUP BY id")
def a21(spark, d):
    own = views.sales(spark, d)
    return rounded(index.band_volume(own, own.where("quantity = 1").select(F.col("sale_id").alias("id"), "bk", F.col("price").alias("ask")), CONFIG), "per_day")


_BOOK_STATS = f"""{SNAPSHOTS},
    valid AS (SELECT *, (ask + bid) / 2 AS mid, row_number() OVER w - 1 AS r, (bid > lag(bid) OVER w)::INT AS up, lag((ask + bid) / 2, 60) OVER w AS was FROM snapshots WHERE ask > 0 AND bid > 0 WINDOW w AS (PARTITION BY product ORDER BY ts)),
    lists AS (SELECT product, count(*) AS samples, avg((ask * {1 - BOOK.tax} - bid > 0)::INT) AS stability, sum(coalesce(up, 0)) AS ups, list_sort(list((ask * {1 - BOOK.tax} - bid) / bid * 100)) AS margins, list_sort(list(ask / bid)) AS ratios, list_sort(list(abs(mid / was - 1) * 100) FILTER (r >= 60 AND (r - 60) % 10 = 0 AND was > 0)) AS moves FROM valid GROUP BY product),
    book AS (SELECT product, samples, stability, margins[len(margins) // 2 + 1] AS median_margin_pct, ratios[len(ratios) // 2 + 1] AS median_ratio, ups / greatest(span / 3600.0, 1 / 60) AS undercut_per_hour, coalesce(moves[len(moves) // 2 + 1], 0) AS vol_pct FROM lists JOIN (SELECT product, max(ts) - min(ts) AS span FROM snapshots GROUP BY product) USING (product))"""
_BOOK_COLUMNS = ("stability", "median_margin_pct", "median_ratio", "undercut_per_hour", "vol_pct")


@query("A22_book_stats", f"WITH {_BOOK_STATS} SELECT product, samples, {', '.join(f'round({c}, 6) AS {c}' for c in _BOOK_COLUMNS)} FROM book")
def a22(spark, d):
    return rounded(book.product_stats(views.snapshots(spark, d), BOOK), *_BOOK_COLUMNS)


_FILLS = f"fills AS (SELECT item, price * 1.1 AS gross, price * 0.01 AS tax, price + (quantity - 25) * 100 AS cost, coalesce(tts_ms / 3600000, 0) AS hold_h FROM sales)"


def _fills(spark, d):
    return views.sales(spark, d).select("item", (F.col("price") * 1.1).alias("gross"), (F.col("price") * 0.01).alias("tax"), (F.col("price") + (F.col("quantity") - 25) * 100).alias("cost"), F.coalesce(F.col("tts_ms") / 3_600_000, F.lit(0.0)).alias("hold_h"))


@query("A23_fill_summary", f"WITH {SALES}, {_FILLS} SELECT item, count(*) AS n, round(sum(gross - tax - cost), 2) AS net, count(*) FILTER (gross - tax - cost > 0) AS wins, count(*) FILTER (gross - tax - cost < 0) AS losses, round(sum(gross - tax - cost) / sum(cost), 6) AS roi, list_sort(list(hold_h))[len(list(hold_h)) // 2 + 1] AS hold_h FROM fills GROUP BY item")
def a23(spark, d):
    return book.fill_summary(_fills(spark, d), ["item"]).withColumn("net", F.round("net", 2)).withColumn("roi", F.round("roi", 6))


@query("A24_posted_stats", "SELECT count(*) AS posted, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS sold, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 6) AS hit_rate, median(o_totalprice) AS median_buy FROM orders")
def a24(spark, d):
    sold = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return table(spark, d, "orders").agg(F.count("*").alias("posted"), sold.alias("sold"), F.round(sold / F.count("*"), 6).alias("hit_rate"), F.median("o_totalprice").alias("median_buy"))


@query("A25_held_slots", "SELECT o_custkey, sum(ceil(o_totalprice / 71000))::BIGINT AS slots FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def a25(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum(F.ceil(F.col("o_totalprice") / 71000)).alias("slots"))


# Joins


@query("J2_live_book", f"WITH {LISTINGS} SELECT uuid, fk, price, lbin, rank, depth FROM market")
def j2(spark, d):
    return lanes.with_market(views.listings(spark, d)).select("uuid", "fk", "price", "lbin", "rank", "depth")


@query("J5_star_cap", f"WITH {SALES}, m AS (SELECT bk AS fk, median(price) AS median FROM sales GROUP BY 1), i AS (SELECT DISTINCT item, stars, split_part(bk, '~', 2) AS kind, bk FROM sales) SELECT i.bk AS id, min(m.median) AS cap FROM i, unnest(range(stars + 1, 11)) AS s(star) JOIN m ON m.fk = item || '*' || star || '~' || kind GROUP BY i.bk")
def j5(spark, d):
    own = views.sales(spark, d)
    items = own.select("item", "stars", F.split_part("bk", F.lit("~"), F.lit(2)).alias("kind"), F.col("bk").alias("id")).distinct()
    medians = own.groupBy(F.col("bk").alias("fk")).agg(F.median("price").alias("median"))
    return index.star_cap(items, medians, k.base_key(F.col("item"), F.col("star"), None, F.col("kind")))


@query("J6_zero_star", f"WITH {KEYED}, {_CLEAN}, cm AS (SELECT fk, median(price) AS median FROM keyed GROUP BY fk HAVING count(*) >= 40), q AS (SELECT DISTINCT fk AS id, bk, item || '*1~' || split_part(bk, '~', 2) AS bare_bk FROM keyed) SELECT id, coalesce(median, c.clean, b.clean) AS baseline FROM q LEFT JOIN cm ON cm.fk = q.id LEFT JOIN clean c ON c.bk = q.bk LEFT JOIN clean b ON b.bk = q.bare_bk")
def j6(spark, d):
    own = views.keyed_sales(spark, d)
    asked = own.select(F.col("fk").alias("id"), F.col("fk").alias("plain_fk"), "bk", F.concat("item", F.lit("*1~"), F.split_part("bk", F.lit("~"), F.lit(2))).alias("bare_bk")).distinct()
    return index.zero_star(index.cheap_median(own, least=40), index.clean_values(own, CONFIG), asked)


@query("J7_key_ladder", f"WITH {LISTINGS}, r AS (SELECT DISTINCT fk AS id, unnest([fk || '+zzz', fk, bk]) AS rung, unnest([0, 1, 2]) AS depth FROM listings) SELECT id, rung, depth, target, round(confidence * pow({CONFIG.ladder_step}, depth), 6) AS confidence FROM r JOIN stats ON stats.fk = r.rung QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1")
def j7(spark, d):
    own = views.keyed_sales(spark, d)
    items = views.listings_of(own).select(F.col("fk").alias("id"), F.array(F.concat("fk", F.lit("+zzz")), "fk", "bk").alias("rungs")).distinct()
    return rounded(index.key_ladder(items, index.key_stats(own, NOW, CONFIG), CONFIG), "confidence")


_POSTED = f"""posted AS (SELECT 'u' || o_orderkey AS uuid, o_custkey AS item_id, o_orderpriority AS bk, epoch(o_orderdate)::DOUBLE AS posted_at, CASE WHEN o_orderstatus <> 'O' THEN epoch(o_orderdate) + 3600 END AS bought_at, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) + 7200 END AS sold_at, o_custkey % 100 AS item FROM orders)"""


def _posted(spark, d):
    t = views.seconds("o_orderdate")
    return table(spark, d, "orders").select(F.concat(F.lit("u"), "o_orderkey").alias("uuid"), F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("bk"), t.alias("posted_at"), F.when(F.col("o_orderstatus") != "O", t + 3600).alias("bought_at"), F.when(F.col("o_orderstatus") == "F", t + 7200).alias("sold_at"), (F.col("o_custkey") % 100).alias("item"))


@query("J9_held", f"WITH {_POSTED} SELECT bk, count(*) FILTER (bought_at IS NOT NULL AND sold_at IS NULL) + count(*) FILTER (bought_at IS NULL AND sold_at IS NULL AND posted_at >= {NOW - 1500 * DAY}) AS held FROM posted GROUP BY bk")
def j9(spark, d):
    return ledger.held(_posted(spark, d), NOW - 1500 * DAY)


@query("J10_unlisted", f"WITH {_POSTED} SELECT item, arg_max(uuid, (bought_at, uuid)) AS uuid FROM posted WHERE bought_at IS NOT NULL AND uuid NOT IN (SELECT 'u' || l_orderkey FROM lineitem WHERE l_linenumber = 3) GROUP BY item")
def j10(spark, d):
    bridge = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.concat(F.lit("u"), "l_orderkey").alias("uuid")).distinct()
    return ledger.unlisted(_posted(spark, d), bridge)


_ENDED = f"ended AS (SELECT DISTINCT 'u' || (o_orderkey * 2) AS sale_id, o_custkey AS item_id, epoch(o_orderdate) + 86400.0 AS sold_at FROM orders), bridge AS (SELECT DISTINCT 'u' || (o_orderkey * 2) AS listing, 'u' || o_orderkey AS b FROM orders WHERE o_orderkey % 5 = 0)"


@query("J11_reconcile", f"WITH {_POSTED}, {_ENDED}, i AS (SELECT e.sale_id, arg_max(p.uuid, (posted_at, p.uuid)) AS i FROM ended e JOIN posted p ON p.item_id = e.item_id AND p.posted_at <= e.sold_at GROUP BY e.sale_id) SELECT sale_id, coalesce(b, d.uuid, i) AS uuid, CASE WHEN b IS NOT NULL THEN 'bridge' WHEN d.uuid IS NOT NULL THEN 'uuid' WHEN i IS NOT NULL THEN 'item' END AS via FROM ended e LEFT JOIN bridge ON listing = sale_id LEFT JOIN posted d ON d.uuid = sale_id LEFT JOIN i USING (sale_id)")
def j11(spark, d):
    own = table(spark, d, "orders")
    sale = F.concat(F.lit("u"), F.col("o_orderkey") * 2)
    ended = own.select(sale.alias("sale_id"), F.col("o_custkey").alias("item_id"), (views.seconds("o_orderdate") + 86400).alias("sold_at")).distinct()
    bridge = own.where("o_orderkey % 5 = 0").select(sale.alias("listing"), F.concat(F.lit("u"), "o_orderkey").alias("uuid")).distinct()
    return ledger.reconcile(ended, _posted(spark, d), bridge)


@query("J14_band_match", f"WITH {LISTINGS}, a AS (SELECT uuid AS id, fk, price * 1.0004 AS price FROM listings WHERE seq % 3 = 0) SELECT id, arg_min(l.uuid, (l.price, l.uuid)) AS uuid FROM a JOIN listings l ON l.fk = a.fk AND abs(l.price - a.price) <= greatest(a.price * 0.001, 1) GROUP BY id")
def j14(spark, d):
    own = views.listings(spark, d)
    return ledger.band_match(own.where("seq % 3 = 0").select(F.col("uuid").alias("id"), "fk", (F.col("price") * 1.0004).alias("price")), own)


# Windows, sets, sorts


@query("W7_price_at_depth", f"WITH {LEVELS} SELECT product, min(price) FILTER (seen >= 120) AS price FROM levels GROUP BY product")
def w7(spark, d):
    return views.levels(spark, d).select("product", v.price_at_depth(F.col("levels"), F.lit(120.0)).alias("price"))


@query("W8_units_ahead", f"WITH {LEVELS} SELECT product, coalesce(sum(amount) FILTER (price > 1500), 0)::DOUBLE AS units FROM levels GROUP BY product")
def w8(spark, d):
    return views.levels(spark, d).select("product", v.units_ahead(F.col("levels"), F.lit(1500.0)).alias("units"))


@query("U1_new_and_old", f"WITH {LISTINGS} SELECT CASE WHEN uuid IN (SELECT uuid FROM listings WHERE seq % 2 = 0) THEN 'old' ELSE 'new' END AS route, count(*) AS n FROM listings GROUP BY 1")
def u1(spark, d):
    own = views.listings(spark, d)
    return lanes.screen(own, own.where("seq % 2 = 0")).groupBy("route").agg(F.count("*").alias("n"))


@query("T5_best_and_worst", f"WITH {SALES}, {_FILLS}, n AS (SELECT item, round(sum(gross - tax - cost), 2) AS net FROM fills GROUP BY item) (SELECT item, net, 'best' AS end FROM n ORDER BY net DESC, item LIMIT 3) UNION ALL (SELECT item, net, 'worst' FROM n ORDER BY net, item LIMIT 3)")
def t5(spark, d):
    own = _fills(spark, d).groupBy("item").agg(F.round(F.sum(F.col("gross") - F.col("tax") - F.col("cost")), 2).alias("net"))
    return book.extremes(own, "net", "item", 3)


# Scalars


@query("F_after_tax", "WITH t AS (SELECT o_orderkey, o_totalprice * 400 AS r FROM orders) SELECT o_orderkey, round(greatest(r * (1 - CASE WHEN r >= 100e6 THEN 0.025 WHEN r >= 10e6 THEN 0.02 ELSE 0.01 END), r * 0.05), 4) AS net FROM t")
def f_tax(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(v.after_tax(F.col("o_totalprice") * 400), 4).alias("net"))


_ASK = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS target, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice * (0.8 + l_discount * 4) END AS lbin, l_linenumber % 2 = 0 AS learned, l_extendedprice * (0.7 + l_tax * 4) AS paid, l_quantity AS age, l_discount * 20 AS per_day, l_returnflag FROM lineitem),
    a AS (SELECT *, age >= CASE WHEN per_day <= 1 THEN 12 ELSE 6 END AS old, floor((age - CASE WHEN per_day <= 1 THEN 12 ELSE 6 END) / 24) AS days, floor(target * CASE WHEN learned THEN 0.97 ELSE 1.05 END) AS opened FROM t),
    b AS (SELECT *, CASE WHEN lbin IS NOT NULL AND (learned OR lbin >= 0.92 * target) THEN least(lbin - 1, opened) ELSE opened END AS o2 FROM a),
    c AS (SELECT *, CASE WHEN old THEN floor(o2 * (1 - least(0.02 * (days + 1), 0.25))) ELSE o2 END AS ask, CASE WHEN old THEN ceil(paid * (1 + greatest(0.05 - 0.03 * (days + 1), -0.10))) ELSE ceil(paid * 1.05) END AS least FROM b)
    SELECT mode, count(*) AS n, round(sum(list_at), 0) AS total FROM (SELECT CASE WHEN least > ask THEN 'cost_floor' WHEN old THEN 'clearance' ELSE 'open' END AS mode, greatest(ask, least) AS list_at FROM c) GROUP BY mode"""


@query("F_listing_price", _ASK)
def f_ask(spark, d):
    x, line = F.col("l_extendedprice"), F.col("l_linenumber")
    ask, mode = v.listing_price(x, F.when(line % 3 != 0, x * (0.8 + F.col("l_discount") * 4)), line % 2 == 0, x * (0.7 + F.col("l_tax") * 4), F.col("l_quantity"), F.col("l_discount") * 20)
    return table(spark, d, "lineitem").select(mode.alias("mode"), ask.alias("a")).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.sum("a"), 0).alias("total"))


# Filters


_GATES = "CASE WHEN item IN ('Brand#11', 'Brand#22') THEN 'blacklist' WHEN profit < 2000 THEN 'profit' WHEN roi < 0.2 AND profit < 30000 THEN 'roi' WHEN confidence < 0.3 THEN 'confidence' WHEN volume < 5 AND profit < 30000 THEN 'volume' END"
_FLIPS = f"WITH {SALES}, flips AS (SELECT sale_id AS id, item, 'median' AS finder, price * 0.3 AS profit, quantity / 50 AS roi, (quantity % 10) / 10 AS confidence, quantity AS volume FROM sales)"


def _flips(spark, d):
    return views.sales(spark, d).select(F.col("sale_id").alias("id"), "item", F.lit("median").alias("finder"), (F.col("price") * 0.3).alias("profit"), (F.col("quantity") / 50).alias("roi"), ((F.col("quantity") % 10) / 10).alias("confidence"), F.col("quantity").alias("volume"))


@query("F4_reject_reasons", f"{_FLIPS} SELECT coalesce({_GATES}, 'passed') AS reason, count(*) AS n FROM flips GROUP BY 1")
def f4(spark, d):
    reason = filters.mismatch(["Brand#11", "Brand#22"], 2000, 0.2, 0.3, 5, waiver=30000)
    return filters.funnel(_flips(spark, d).withColumn("reason", reason))


#: Tier rules: number, item, blacklist, least profit, roi and confidence, priority, scale.
_RULES = [(1, "Brand#11", True, 0.0, 0.0, 0.0, 0, 1.0), (2, "Brand#22", False, 1000.0, 0.1, 0.2, 5, 0.9), (3, "GLOBAL", False, 9000.0, 0.3, 0.4, 3, 0.95), (4, "GLOBAL", False, 20000.0, 0.1, 0.1, 3, 0.93)]
_RULE_ROWS = ", ".join(f"({n}, '{i}', {str(b).lower()}, {p}, {r}, {c}, {y}, {s}::DOUBLE)" for n, i, b, p, r, c, y, s in _RULES)


@query("F5_tier_filter", f"{_FLIPS}, rules(no, item, ban, p, r, c, prio, scale) AS (VALUES {_RULE_ROWS}), j AS (SELECT f.id, f.profit, f.roi, bool_or(coalesce(ban, false)) AS banned, max((prio, -no, scale)) FILTER (NOT ban AND profit >= p AND roi >= r AND confidence >= c) AS best FROM flips f LEFT JOIN rules ON rules.item = f.item OR rules.item = 'GLOBAL' GROUP BY f.id, f.profit, f.roi, f.confidence), o AS (SELECT *, CASE WHEN banned THEN false WHEN best IS NOT NULL THEN true ELSE profit >= 15000 AND roi >= 0.5 END AS pass FROM j) SELECT id, pass, CASE WHEN pass THEN coalesce(best[3], 0.97) END AS scale, CASE WHEN pass THEN best[1] END AS priority FROM o")
def f5(spark, d):
    rules = spark.createDataFrame(_RULES, "rule_no int, item string, blacklist boolean, min_profit double, min_roi double, min_confidence double, priority int, scale double")
    return filters.tiers(_flips(spark, d), rules, 15000, 0.5)


@query("F8_client_filter", f"{_FLIPS} SELECT id FROM flips WHERE profit BETWEEN 5000 AND 20000 AND roi >= 0.4 AND item NOT IN ('Brand#13') AND finder IN ('median', 'snipe')")
def f8(spark, d):
    return _flips(spark, d).where(filters.matches({"profit": (5000, 20000), "roi": (0.4, None)}, {"finder": ["median", "snipe"]}, {"item": ["Brand#13"]})).select("id")


@query("F9_reject_category", f"{_FLIPS}, r AS (SELECT coalesce({_GATES}, 'passed') AS reason FROM flips) SELECT CASE WHEN reason LIKE '%pro%' THEN 'money' WHEN reason LIKE '%roi%' THEN 'money' WHEN reason LIKE '%black%' THEN 'list' ELSE 'other' END AS category, count(*) AS n FROM r GROUP BY 1")
def f9(spark, d):
    reason = F.coalesce(filters.mismatch(["Brand#11", "Brand#22"], 2000, 0.2, 0.3, 5, waiver=30000), F.lit("passed"))
    return _flips(spark, d).groupBy(filters.category(reason, [("pro", "money"), ("roi", "money"), ("black", "list")]).alias("category")).agg(F.count("*").alias("n"))


# Lanes

_NET = lambda r: f"greatest({r} * (1 - CASE WHEN {r} >= 100e6 THEN 0.025 WHEN {r} >= 10e6 THEN 0.02 ELSE 0.01 END), {r} * 0.05)"
_COUNTS = "LEFT JOIN (SELECT a.uuid AS u, count(*) FILTER (l.price < a.reference) AS undercuts, count(*) FILTER (l.price >= a.reference * 0.9) AS support FROM {t} a JOIN listings l ON l.fk = a.fk AND l.uuid <> a.uuid GROUP BY 1) ON u = uuid"


def _confidence(base: str, a: str, roi: str, samples: str, volatility: str) -> str:
    agree = f"CASE WHEN lbin > 0 AND {a} > 0 THEN 0.6 + 0.4 * greatest(1 - (greatest({a}, lbin) - least({a}, lbin)) / greatest({a}, lbin) / 0.25, 0) ELSE 0.85 END"
    margin = f"least(1 / (1 + ({roi} - 0.6) * 0.8) + CASE WHEN coalesce(support, 0) >= 2 THEN 0.3 ELSE 0 END, CASE WHEN coalesce(support, 0) >= 2 THEN 1 ELSE 9 END)"
    p = f"({agree}) * CASE WHEN {roi} > 0.6 THEN {margin} ELSE 1 END"
    return f"least(greatest({base} * ({p} + (1 - {p}) * least({samples} / 12.0, 1) * (1 - least(greatest({volatility}, 0), 1))), 0), 1)"


_SNIPE = f"""sn0 AS (SELECT *, least(clean, lbin) AS reference FROM market JOIN clean USING (bk) WHERE fk = bk),
    sn1 AS (SELECT *, {_NET("reference")} - price AS profit FROM sn0 WHERE price <= reference * {1 - LANES.snipe_margin} AND {_NET("reference")} - price >= {LANES.min_profit}),
    snipe AS (SELECT uuid, 'snipe' AS finder, price, reference, profit, {_confidence("0.9", "reference", "profit / price", "n", "0")} AS confidence, 'clean_snipe' AS guard FROM sn1 {_COUNTS.format(t="sn1")})"""
_GUARD = "CASE WHEN g = '' THEN 'none' ELSE g END"
_MEDIAN = f"""md0 AS (SELECT *, target * (1 + 0.5 * least(trend_pct, 0)) AS resale FROM market JOIN stats USING (fk)),
    md1 AS (SELECT *, least(resale, lbin) AS reference, {_NET("least(resale, lbin)")} - price AS profit FROM md0),
    md2 AS (SELECT *, concat_ws(',', CASE WHEN manipulated THEN 'manipulated' END, CASE WHEN volatility > 0.4 THEN 'volatile' END, CASE WHEN last_sold_ago_h > 48 THEN 'stale' END, CASE WHEN volume_per_day < 3 THEN 'low_volume' END, CASE WHEN trend_pct < -0.05 THEN 'falling' END) AS g FROM md1 {_COUNTS.format(t="md1")}),
    med AS (SELECT uuid, 'median' AS finder, price, reference, profit, {_confidence("confidence", "resale", "profit / price", "samples", "volatility")} AS confidence, {_GUARD} AS guard,
        CASE WHEN trend_pct <= {LANES.trend_floor} THEN 'falling' WHEN price > reference * {1 - LANES.min_margin} THEN 'margin' WHEN profit < {LANES.min_profit} THEN 'profit' WHEN coalesce(undercuts, 0) >= {LANES.max_undercuts} THEN 'undercut' END AS reason FROM md2)"""
_DOM = f"""dm AS (SELECT *, least(target, lbin) AS reference, {_NET("least(target, lbin)")} - price AS profit FROM market JOIN dom USING (uuid) JOIN domshare USING (uuid) WHERE fk NOT IN (SELECT fk FROM stats)),
    dominance AS (SELECT uuid, 'dominance' AS finder, price, reference, profit, CASE WHEN manipulated THEN 0.35 ELSE 0.7 END::DOUBLE AS confidence, 'dominance' AS guard FROM dm WHERE price <= reference * {1 - LANES.min_margin} AND profit >= {LANES.min_profit})"""
_LBIN = f"""lb0 AS (SELECT m.*, c.median * {LANES.lbin_sold_mult} AS cap, least(second, c.median * {LANES.lbin_sold_mult}) AS reference FROM market m JOIN base USING (bk) LEFT JOIN (SELECT fk, median(price) AS median FROM keyed GROUP BY fk HAVING count(*) >= 3) c USING (fk) WHERE rank = 1 AND depth >= {LANES.lbin_min_listings} AND base.n >= {LANES.lbin_min_sold}),
    lb1 AS (SELECT *, {_NET("reference")} - price AS profit, concat_ws(',', CASE WHEN depth < 6 THEN 'thin_market' END, CASE WHEN cap < second THEN 'wall_capped' END) AS g, 0.6 * least(depth / 6.0, 1) + 0.4 * greatest(1 - CASE WHEN depth > 2 THEN (dearest - second) / reference ELSE 0 END, 0) AS confidence FROM lb0),
    lbin AS (SELECT uuid, 'lbin' AS finder, price, reference, profit, confidence, {_GUARD} AS guard FROM lb1 WHERE price <= reference * {1 - LANES.min_margin} AND profit >= {LANES.min_profit})"""
_LANE = "uuid, finder, price, reference, round(profit, 6) AS profit, round(confidence, 6) AS confidence, guard"


def _lane(df: DataFrame) -> DataFrame:
    return df.withColumn("profit", F.round("profit", 6)).withColumn("confidence", F.round("confidence", 6))


def _parts(spark, d):
    """Keyed sales, listings, listings with their market, and statistics. The last two are written once, since several lanes
    read them; sales and the lists that key them are written already."""
    own = views.keyed_sales(spark, d)
    live = views.listings_of(own)
    return own, live, materialised(lanes.with_market(live), "market", large=True), materialised(index.key_stats(own, NOW, CONFIG), "stats")


def _unpriced(live: DataFrame, stats: DataFrame) -> DataFrame:
    return live.join(stats.select("fk"), "fk", "left_anti")


@query("L1_snipe", f"WITH {LISTINGS}, {_CLEAN}, {_SNIPE} SELECT {_LANE} FROM snipe")
def l1(spark, d):
    own, _, market, _ = _parts(spark, d)
    return _lane(lanes.snipe(market, index.clean_values(own, CONFIG), LANES))


@query("L2_median", f"WITH {LISTINGS}, {_MEDIAN} SELECT {_LANE}, reason FROM med")
def l2(spark, d):
    _, _, market, stats = _parts(spark, d)
    return _lane(lanes.median_lane(market, stats, LANES))


@query("L4_dominance", f"WITH {LISTINGS}, {_DOMINANCE}, {_DOM} SELECT {_LANE} FROM dominance")
def l4(spark, d):
    own, live, market, stats = _parts(spark, d)
    return _lane(lanes.dominance_lane(market, index.dominance_floor(_unpriced(live, stats), own, RARE), stats, LANES))


@query("L5_lbin", f"WITH {LISTINGS}, {_LBIN} SELECT {_LANE} FROM lbin")
def l5(spark, d):
    own, _, market, _ = _parts(spark, d)
    return _lane(lanes.lbin_lane(market, index.base_stats(own), index.cheap_median(own), LANES))


@query("L6_screen", f"WITH {LISTINGS} SELECT uuid, CASE WHEN price > c.median * 1.3 THEN 'r' WHEN s.fk IS NOT NULL THEN 'c' ELSE 'l' END AS verdict FROM listings l LEFT JOIN stats s ON s.fk = l.fk LEFT JOIN (SELECT fk, median(price) AS median FROM keyed GROUP BY fk HAVING count(*) >= 3) c ON c.fk = l.fk")
def l6(spark, d):
    own, live, _, stats = _parts(spark, d)
    return lanes.verdicts(live, stats, index.cheap_median(own))


@query(
    "L7_sweep",
    f"""WITH {LISTINGS}, {_CLEAN}, {_DOMINANCE}, {_SNIPE}, {_MEDIAN}, {_DOM}, {_LBIN},
    allof AS (SELECT *, 0 AS place, 0 AS phase FROM snipe UNION ALL SELECT * EXCLUDE (reason), 1, 0 FROM med WHERE reason IS NULL UNION ALL SELECT *, 3, 1 FROM dominance UNION ALL SELECT *, 4, 2 FROM lbin),
    one AS (SELECT * FROM allof QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY place) = 1),
    turns AS (SELECT o.*, l.seller, row_number() OVER (PARTITION BY l.seller, l.fk ORDER BY phase, seq, o.uuid) AS turn FROM one o JOIN listings l USING (uuid))
    SELECT {_LANE} FROM turns WHERE seller = '' OR turn <= {LANES.relist_limit}""",
)
def l7(spark, d):
    own, live, market, stats = _parts(spark, d)
    found = lanes.first_lane(
        lanes.snipe(market, index.clean_values(own, CONFIG), LANES), lanes.median_lane(market, stats, LANES).where("reason is null"), lanes.dominance_lane(market, index.dominance_floor(_unpriced(live, stats), own, RARE), stats, LANES), lanes.lbin_lane(market, index.base_stats(own), index.cheap_median(own), LANES)
    )
    return _lane(lanes.throttle(found, live, None, LANES)).select("uuid", "finder", "price", "reference", "profit", "confidence", "guard")


_PLANS = f"""{_BOOK_STATS}, last AS (SELECT product, arg_max(ask, ts) AS ask, arg_max(bid, ts) AS bid, count(*)::DOUBLE AS flow FROM snapshots GROUP BY product),
    b0 AS (SELECT *, (floor(bid * 10) + 1) / 10 AS buy_at, floor(least(1e5 / ((floor(bid * 10) + 1) / 10), flow)) AS units FROM last JOIN book USING (product)),
    b1 AS (SELECT *, CASE WHEN flow * 0.5 >= greatest(units, {BOOK.min_depth_units}) THEN ask WHEN flow * 0.5 + flow * 0.7 >= greatest(units, {BOOK.min_depth_units}) THEN ask + 0.2 END AS backed FROM b0),
    b2 AS (SELECT *, exit_at * {1 - BOOK.tax} - buy_at AS net FROM (SELECT *, least((ceil(ask * 10) - 1) / 10, backed) AS exit_at FROM b1))"""


@query("L11_buy_plans", f"WITH {_PLANS} SELECT product, CASE WHEN ask <= 0 OR bid <= 0 THEN 'one-sided book' WHEN samples < {BOOK.min_samples} THEN 'history too thin' WHEN stability < {BOOK.min_stability} THEN 'spread not persistent' WHEN units < 1 THEN 'cannot afford one unit' WHEN backed IS NULL THEN 'sell side too thin' WHEN net <= 0 THEN 'no margin after tax' WHEN net / buy_at * 100 < {BOOK.min_margin_pct} THEN 'margin below floor' WHEN vol_pct > net / buy_at * 100 / 2 THEN 'too volatile' END AS reason, buy_at, units, exit_at, round(net, 6) AS net, round(net * units * {BOOK.fill_p} / {BOOK.fill_hours}, 4) AS score FROM b2")
def l11(spark, d):
    own = views.snapshots(spark, d)
    last = own.groupBy("product").agg(F.max_by("ask", "ts").alias("ask"), F.max_by("bid", "ts").alias("bid"), F.count("*").cast("double").alias("flow"))
    level = lambda price, amount: F.struct(price.alias("price"), amount.alias("amount"))
    last = last.withColumn("levels", F.array(level(F.col("ask"), F.col("flow") * 0.5), level(F.col("ask") + 0.2, F.col("flow") * 0.7)))
    return book.buy_plans(last, book.product_stats(own, BOOK), 1e5, BOOK).withColumn("net", F.round("net", 6)).withColumn("score", F.round("score", 4))


# Offline studies


@query("X1_backtest", f"WITH {SALES}, tr AS (SELECT bk, median(price) AS est FROM sales WHERE sold_at < {NOW - 1000 * DAY} GROUP BY bk HAVING count(*) >= 5), te AS (SELECT s.bk, price, est, abs(est / price - 1) AS err FROM sales s LEFT JOIN tr USING (bk) WHERE sold_at >= {NOW - 1000 * DAY}), l AS (SELECT list_sort(list(err) FILTER (est IS NOT NULL)) AS e, count(*) AS n, count(est) AS covered, count(*) FILTER (est > price * 1.3) AS over FROM te) SELECT n, covered, round(e[floor((len(e) - 1) * 0.5)::INT + 1], 6) AS p50, round(e[floor((len(e) - 1) * 0.75)::INT + 1], 6) AS p75, round(e[floor((len(e) - 1) * 0.9)::INT + 1], 6) AS p90, over FROM l")
def x1(spark, d):
    own = views.sales(spark, d)
    cut = NOW - 1000 * DAY
    trained = own.where(F.col("sold_at") < cut).groupBy("bk").agg(F.median("price").alias("est"), F.count("*").alias("n")).where("n >= 5").drop("n")
    test = own.where(F.col("sold_at") >= cut).join(trained, "bk", "left").withColumn("err", F.abs(F.col("est") / F.col("price") - 1))
    # errors are rounded into a histogram before they are ranked, so the quantiles don't meet in one task
    bins = test.where("err is not null").groupBy("err").agg(F.count("*").alias("c"))
    whole = test.agg(F.count("*").alias("n"), F.count("est").alias("covered"), F.count(F.when(F.col("est") > F.col("price") * 1.3, 1)).alias("over")).first()
    places = [int((whole.covered - 1) * q) for q in (0.5, 0.75, 0.9)]
    values = quantiles(bins, "err", "c", places) if whole.covered else [None] * 3
    return spark.createDataFrame([(whole.n, whole.covered, *(None if x is None else round(x, 6) for x in values), whole.over)], "n long, covered long, p50 double, p75 double, p90 double, over long")


def quantiles(bins: DataFrame, value: str, count: str, places: list[int], parts: int = 64) -> list[float]:
    """The values at places (from 0) of the ascending order of a histogram: value ranges are counted first, then only the
    ranges that hold a place are looked at, all in Spark but for the parts' counts."""
    ranged = materialised(bins.repartitionByRange(parts, value).withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("part").agg(F.sum(count).alias("n")).orderBy("part").collect()  # at most `parts` rows
    out = []
    for place in places:
        before = 0
        for r in ends:
            if before + r.n > place:
                break
            before += r.n
        from pyspark.sql import Window

        own = ranged.where(F.col("part") == r.part).withColumn("upto", F.sum(count).over(Window.orderBy(value)))
        out.append(own.where(F.col("upto") > place - before).agg(F.min(value)).first()[0])
    return out


_DAYS = [300, 600, 1200, 2400]


@query("X3_reference_windows", f"WITH {SALES}, w(days) AS (VALUES {', '.join(f'({x})' for x in _DAYS)}), c AS (SELECT days, bk, count(*) AS n FROM sales, w WHERE sold_at >= {NOW} - days * {DAY} GROUP BY 1, 2) SELECT days, count(*) FILTER (n >= 5) AS priceable, count(*) AS keys FROM c GROUP BY days")
def x3(spark, d):
    own = views.sales(spark, d).select("bk", F.explode(F.array(*(F.when(F.col("sold_at") >= NOW - x * DAY, F.lit(x)) for x in _DAYS))).alias("days")).where("days is not null")
    return own.groupBy("days", "bk").agg(F.count("*").alias("n")).groupBy("days").agg(F.count(F.when(F.col("n") >= 5, 1)).alias("priceable"), F.count("*").alias("keys"))


@query("X4_bare_and_total", f"WITH {KEYED} SELECT bk, count(*) FILTER (fk = bk) AS bare, count(*) AS total, round(sum(price), 2) AS volume FROM keyed GROUP BY bk")
def x4(spark, d):
    return views.keyed_sales(spark, d).groupBy("bk").agg(F.count(F.when(F.col("fk") == F.col("bk"), 1)).alias("bare"), F.count("*").alias("total"), F.round(F.sum("price"), 2).alias("volume"))


@query("X6_prescreen", f"WITH {LISTINGS}, c AS (SELECT fk, median(price) AS m FROM keyed GROUP BY fk HAVING count(*) >= 3) SELECT slack::DOUBLE AS slack, count(*) FILTER (price > m * slack) AS blocked, count(*) AS n FROM listings JOIN c USING (fk), (VALUES (1.0), (1.3), (1.5)) AS s(slack) GROUP BY slack")
def x6(spark, d):
    sold = views.keyed_sales(spark, d)
    medians = materialised(index.cheap_median(sold).select("fk", "median"), "medians")
    own = views.listings_of(sold).join(medians, "fk")
    return own.select("price", "median", F.explode(F.array(*(F.lit(float(x)) for x in (1.0, 1.3, 1.5)))).alias("slack")).groupBy("slack").agg(F.count(F.when(F.col("price") > F.col("median") * F.col("slack"), 1)).alias("blocked"), F.count("*").alias("n"))


@query("X7_size_bands", f"WITH {SALES}, m AS (SELECT item, median(price) AS pooled FROM sales GROUP BY item) SELECT s.item, floor(size / 10)::BIGINT * 10 AS band, count(*) AS n, round(median(price) / any_value(pooled), 6) AS ratio FROM sales s JOIN m USING (item) GROUP BY 1, 2")
def x7(spark, d):
    own = views.sales(spark, d)
    pooled = own.groupBy("item").agg(F.median("price").alias("pooled"))
    return own.join(pooled, "item").groupBy("item", (F.floor(F.col("size") / 10) * 10).alias("band")).agg(F.count("*").alias("n"), F.round(F.median("price") / F.first("pooled"), 6).alias("ratio"))


@query("X10_fields_by_volume", f"WITH {SALES} SELECT item, count(*) AS n, round(avg(price), 4) AS mean FROM sales GROUP BY item")
def x10(spark, d):
    return views.sales(spark, d).groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"))

