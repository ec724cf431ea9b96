"""Statistics of past sales per key. Sales: sale_id, bk, fk, item, price, sold_at (s), seller, tts_ms, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.config import Pricing
from stallkeeper.functions import orderstats as o
from stallkeeper.functions import valuation as v
from stallkeeper.functions.counts import counts_below
from stallkeeper.operators import dominance
from stallkeeper.sources.tables import materialised


def fresh(sales: DataFrame, now: float, c: Pricing) -> DataFrame:
    return sales.where((F.col("sold_at") >= now - c.max_age_days * 86400) & (F.col("price") > 0))


def base_stats(sales: DataFrame) -> DataFrame:
    """bk, n, base_value and base_high: the elements at floor(0.20 n) and floor(0.95 n)."""
    return o.at_share(sales, ["bk"], "price", {"base_value": 0.20, "base_high": 0.95})


def feature_groups(sales: DataFrame) -> DataFrame:
    """bk, feature, n and median over the sales that have the feature."""
    return o.medians(sales.select("bk", "price", F.explode("features").alias("feature")), ["bk", "feature"], "price").select("bk", "feature", "n", "median")


def significant(groups: DataFrame, base: DataFrame, c: Pricing) -> DataFrame:
    """Features whose sales' median is far enough above their base value, seen often enough."""
    joined = groups.join(base.select("bk", "base_value"), "bk")
    return joined.where((F.col("median") - F.col("base_value") >= c.min_share * F.col("base_value")) & (F.col("n") >= c.min_samples))


def feature_tests(sales: DataFrame, base: DataFrame, c: Pricing) -> DataFrame:
    """bk, feature, base_value and learned, whether significant() has it, of every key and feature of the sales (bk, price,
    features). base: bk, base_value.

    A median is dear enough if more than half of the prices are, or half and the mean of the two in the middle, so
    counts and extremes on either side of the bar do: they are added up before a shuffle, and no prices are sorted."""
    dear = lambda price: price - F.col("base_value") >= c.min_share * F.col("base_value")
    own = sales.select("bk", "price", "features").join(base.select("bk", "base_value"), "bk", "left")
    own = own.select("bk", "price", "base_value", dear(F.col("price")).alias("dear"), F.explode("features").alias("feature"))
    per = own.groupBy("bk", "feature").agg(
        F.min("base_value").alias("base_value"), F.count("price").alias("n"), F.count(F.when(~F.col("dear"), 1)).alias("cheap"),
        F.max(F.when(~F.col("dear"), F.col("price"))).alias("under"), F.min(F.when(F.col("dear"), F.col("price"))).alias("over"),
    )
    half = F.col("n") - 2 * F.col("cheap")
    above = (half > 0) | ((half == 0) & dear((F.col("under") + F.col("over")) / 2))
    return per.select("bk", "feature", "base_value", F.coalesce(F.col("base_value").isNotNull() & (F.col("n") >= c.min_samples) & above, F.lit(False)).alias("learned"))


def with_final_key(sales: DataFrame, features: DataFrame) -> DataFrame:
    """Adds fk: bk, and # with the sale's significant features, sorted. A key's significant features are a short list that
    its sales are joined to; sales are neither exploded nor gathered. The lists are written, so what they are made from
    isn't done again by each reader of the sales, and the join knows how small they are and needn't shuffle the sales."""
    known = materialised(features.groupBy("bk").agg(F.collect_set("feature").alias("sig")), "significant")
    own = F.array_sort(F.array_intersect("features", F.coalesce("sig", F.array().cast("array<string>"))))
    joined = sales.join(known, "bk", "left").withColumn("sig", own)
    return joined.withColumn("fk", F.when(F.size("sig") > 0, F.concat("bk", F.lit("#"), F.array_join("sig", "+"))).otherwise(F.col("bk"))).drop("sig")


def signatures(features: DataFrame) -> DataFrame:
    return features.groupBy("bk").agg(F.array_join(F.array_sort(F.collect_set("feature")), ";").alias("signature"))


def key_stats(
    sales: DataFrame, now: float, c: Pricing, key: str = "fk", widen: tuple[float, ...] = (), trends: DataFrame | None = None, caps: DataFrame | None = None, sell_through: DataFrame | None = None
) -> DataFrame:
    """Price statistics per key over its ref_cap newest sales, each seller's cheapest only.

    The recent price is the median of the last short_hours, or of the first of the windows widen (hours, ascending) that
    holds 3 sales. Where none does, a falling trend of the base key lowers the long-term price, if trends (bk, trend_pct)
    are given. caps (key, cap) bound the target by what better items sell for; items that often stay unsold are discounted by
    sell_through (item, sell_through). A key's sales are shuffled once."""
    capped = o.newest(sales, [key], ["sold_at", "sale_id"], c.ref_cap)
    named = F.coalesce("seller", F.lit("")) != ""
    who = F.when(named, F.col("seller")).otherwise(F.concat(F.lit("#/"), "sale_id"))
    extra = [x for x, table in (("bk", trends), ("item", sell_through)) if table is not None and x != key]  # a key has one of each
    per = capped.groupBy(key, named.alias("named"), who.alias("who")).agg(F.min(F.struct("price", (-F.col("sold_at")).alias("t"))).alias("b"), F.count("*").alias("c"), *(F.min(x).alias(x) for x in extra))
    per = per.select(key, "named", "c", F.col("b.price").alias("price"), (-F.col("b.t")).alias("sold_at"), *extra)
    inside = [F.col("sold_at") >= now - h * 3600 for h in (c.short_hours, *widen)]
    recent = F.coalesce(*(F.when(F.count(F.when(x, 1)) >= 3, F.median(F.when(x, F.col("price")))) for x in inside))
    stats = per.groupBy(key).agg(
        F.count("*").alias("samples"), F.median("price").alias("long_term"), recent.alias("recent"), F.stddev_pop("price").alias("sd"), o.sorted_list("price").alias("prices"), o.span_days("sold_at", c.max_age_days).alias("span"),
        F.max("sold_at").alias("last"), F.sum("c").alias("raw"), F.max(F.when(F.col("named"), F.col("c")).otherwise(0)).alias("top"), *(F.min(x).alias(x) for x in extra),
    ).where(F.col("samples") >= c.min_refs)  # ref_cap rows at most
    base = F.lit(None).cast("double")
    if trends is not None:
        stats = stats.join(trends.select("bk", F.col("trend_pct").alias("__base")), "bk", "left")
        base = F.when(F.col("recent").isNull() & (F.col("__base") < 0), F.col("__base"))
    short = F.coalesce("recent", F.col("long_term") * (1 + base), "long_term")
    target = F.least(short, "long_term")
    if caps is not None:
        stats = stats.join(caps.select(key, "cap"), key, "left")
        target = F.least(target, "cap")
    if sell_through is not None:
        stats = stats.join(sell_through.select("item", "sell_through"), "item", "left")
        target = target * v.liquidity_factor(F.col("sell_through"))
    volatility = F.when(F.col("long_term") > 0, F.least(F.col("sd") / F.col("long_term"), F.lit(1.0))).otherwise(1.0)
    per_day = F.col("samples") / F.col("span")
    manipulated = F.col("top") / F.col("raw") >= c.manipulated_share
    quartiles = o.rank_percentile(F.col("prices"), 0.75) - o.rank_percentile(F.col("prices"), 0.25)
    return stats.select(
        key, target.alias("target"), "samples", per_day.alias("volume_per_day"), F.when(F.col("long_term") > 0, quartiles / F.col("long_term")).otherwise(1.0).alias("spread_pct"),
        F.element_at("prices", 1).alias("lowest_ref"), F.element_at("prices", -1).alias("highest_ref"), F.greatest((F.lit(now) - F.col("last")) / 3600.0, F.lit(0.0)).alias("last_sold_ago_h"),
        v.pool_confidence(F.col("samples"), volatility, per_day, manipulated).alias("confidence"), volatility.alias("volatility"), manipulated.alias("manipulated"),
        F.when(F.col("recent").isNotNull() & (F.col("long_term") > 0), (short - F.col("long_term")) / F.col("long_term")).otherwise(F.coalesce(base, F.lit(0.0))).alias("trend_pct"),
    )


def cheap_median(sales: DataFrame, key: str = "fk", least: int = 3) -> DataFrame:
    return o.medians(sales, [key], "price").select(key, "median", "n").where(F.col("n") >= least)


def fair_time_to_sell(sales: DataFrame, key: str = "fk") -> DataFrame:
    """Median hours to sell among sales within 15 percent of the key's median price."""
    joined = sales.join(sales.groupBy(key).agg(F.median("price").alias("med")).where("med > 0"), key).where("tts_ms is not null")
    fair = F.col("price").between(F.col("med") * 0.85, F.col("med") * 1.15)
    return joined.groupBy(key).agg((F.median(F.when(fair, F.col("tts_ms"))) / 3_600_000).alias("fair_tts_h"), F.count(F.when(fair, 1)).alias("n_fair"), F.count("*").alias("n_all")).where("n_fair > 0")


def clean_values(sales: DataFrame, c: Pricing) -> DataFrame:
    """Of pools without significant features (fk = bk): median of sellers' cheapest, their count and volume a day."""
    bare = sales.where("fk = bk")
    big = bare.groupBy("bk").count().where(F.col("count") >= c.min_refs).select("bk")
    floor = o.seller_floor(bare.join(big, "bk"), ["bk"], ["sale_id"])
    return floor.groupBy("bk").agg(F.median("price").alias("clean"), F.count("*").alias("n"), (F.count("*") / o.span_days("sold_at", c.max_age_days)).alias("volume_per_day")).where(F.col("n") >= c.min_refs)


def base_trend(sales: DataFrame, now: float, hours: list[float], c: Pricing) -> DataFrame:
    """bk and trend_pct: the median of the newest trend_rows sales of the smallest window with 5 or more against the
    median of all, less 1; 0 where there are too few."""
    pool = sales.where("fk = bk")
    whole = pool.groupBy("bk").agg(F.median("price").alias("all"), F.count("*").alias("n"))
    top = o.newest(pool, ["bk"], ["sold_at", "sale_id"], c.trend_rows)
    rungs = [F.when(F.count(F.when(F.col("sold_at") >= now - h * 3600, 1)) >= 5, F.median(F.when(F.col("sold_at") >= now - h * 3600, F.col("price")))) for h in hours]
    recent = top.groupBy("bk").agg(F.coalesce(*rungs).alias("recent"))
    known = (F.col("n") >= c.min_refs) & (F.col("all") != 0) & F.col("recent").isNotNull()
    return whole.join(recent, "bk").select("bk", F.when(known, (F.col("recent") - F.col("all")) / F.col("all")).otherwise(0.0).alias("trend_pct"))


def thin_evidence(sales: DataFrame, key: str = "fk", rows: int = 12) -> DataFrame:
    counts = sales.groupBy(key).agg(F.count("*").alias("n"))
    return o.newest(sales, [key], ["sold_at", "sale_id"], rows).groupBy(key).agg(F.median("price").alias("median")).join(counts, key)


def base_volume(sales: DataFrame, c: Pricing) -> DataFrame:
    return sales.groupBy("bk").agg((F.count("*") / o.span_days("sold_at", c.max_age_days)).alias("volume_per_day"))


def dominance_floor(listings: DataFrame, sales: DataFrame, c: Pricing) -> DataFrame:
    """dominance.floors() of listings (uuid, bk, features) over sales by their tokens."""
    return dominance.floors(listings.withColumn("axes", dominance.token_axes(F.col("features"))), sales.withColumn("axes", dominance.token_axes(F.col("features"))), c)


def key_ladder(items: DataFrame, stats: DataFrame, c: Pricing) -> DataFrame:
    """Prices items (id, rungs: keys from fine to coarse) by the first rung that has statistics."""
    rungs = items.select("id", F.posexplode("rungs").alias("depth", "rung")).join(stats, F.col("rung") == F.col("fk"))
    best = rungs.groupBy("id").agg(F.min_by(F.struct("rung", "target", "confidence", "depth"), "depth").alias("b"))
    return best.select("id", "b.rung", "b.depth", "b.target", (F.col("b.confidence") * F.pow(F.lit(c.ladder_step), F.col("b.depth"))).alias("confidence"))


def band_volume(sales: DataFrame, asks: DataFrame, c: Pricing) -> DataFrame:
    """asks (id, bk, ask): sales a day at the ask or more."""
    span = sales.groupBy("bk").agg(o.span_days("sold_at", c.max_age_days).alias("span"))
    found = counts_below(sales.select("bk", "price"), asks.select("id", "bk", "ask"), ["bk"], "price", "ask")
    return found.join(span, "bk").select("id", ((F.col("of") - F.col("below")) / F.col("span")).alias("per_day"))


def zero_star(sales_median: DataFrame, clean: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (id, plain_fk, bk, bare_bk): the baseline without stars by three fallbacks."""
    c = materialised(clean.select("bk", "clean"), "clean")
    return keys.join(sales_median.select(F.col("fk").alias("plain_fk"), "median"), "plain_fk", "left").join(c, "bk", "left").join(c.select(F.col("bk").alias("bare_bk"), F.col("clean").alias("bare")), "bare_bk", "left").select("id", F.coalesce("median", "clean", "bare").alias("baseline"))


def star_cap(items: DataFrame, medians: DataFrame, key: Column, top: int = 10) -> DataFrame:
    """items (id, stars, ...): the least median among pools of the same item with more stars; key builds a pool's key of
    the column star."""
    more = items.where(F.col("stars") < top).withColumn("star", F.explode(F.sequence(F.col("stars") + 1, F.lit(top))))
    return more.withColumn("k", key).join(medians.select(F.col("fk").alias("k"), "median"), "k").groupBy("id").agg(F.min("median").alias("cap"))


def manipulated_share(sales: DataFrame, key: str = "fk") -> DataFrame:
    per = sales.where("seller <> ''").groupBy(key, "seller").agg(F.count("*").alias("c"))
    return per.groupBy(key).agg(F.max("c").alias("top")).join(sales.groupBy(key).agg(F.count("*").alias("n")), key).select(key, (F.col("top") / F.col("n")).alias("share"))


def newest_sales(sales: DataFrame, n: int) -> DataFrame:
    return sales.orderBy(F.desc("sold_at"), F.desc("sale_id")).limit(n)


def rank_of(cols: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*cols).orderBy(*order))


def star_significance(sales: DataFrame, c: Pricing, bare: Column) -> DataFrame:
    """Stars (bare key, stars) whose sales' median lies far enough above the base value of the bare key."""
    own = sales.withColumn("bare", bare)
    base = o.at_share(own, ["bare"], "price", {"base_value": 0.20}).select("bare", "base_value")
    groups = own.where("stars > 0").groupBy("bare", "stars").agg(F.count("*").alias("n"), F.median("price").alias("median"))
    return groups.join(base, "bare").where((F.col("n") >= c.min_samples) & (F.col("median") - F.col("base_value") >= c.min_share * F.col("base_value")))


def widened(sales: DataFrame, key: str, now: float, hours: list[float], least: int) -> DataFrame:
    """Per key the median over the smallest of ascending windows with least sales or more, else over the widest, which
    may hold fewer; keys without any there are left out."""
    inside = [F.col("sold_at") >= now - h * 3600 for h in hours]
    counts = [F.count(F.when(x, 1)).alias(f"n{i}") for i, x in enumerate(inside)]
    medians = [F.median(F.when(x, F.col("price"))).alias(f"m{i}") for i, x in enumerate(inside)]
    rungs = sales.where(inside[-1]).groupBy(key).agg(*counts, *medians)
    pick = lambda c: F.coalesce(*(F.when(F.col(f"n{i}") >= least, F.col(f"{c}{i}")) for i in range(len(hours))), F.col(f"{c}{len(hours) - 1}"))
    return rungs.select(key, pick("m").alias("median"), pick("n").alias("n"))


def dispersion(prices: Column, median: Column, sd: Column, robust: bool) -> Column:
    """Spread of an ascending array over its median, 1 at most: standard deviation, or interquartile range / 1.349."""
    spread = (o.rank_percentile(prices, 0.75) - o.rank_percentile(prices, 0.25)) / 1.349 if robust else sd
    return F.when(median > 0, F.least(spread / median, F.lit(1.0))).otherwise(1.0)


def binding_feature_floor(listings: DataFrame, groups: DataFrame, gap: float) -> DataFrame:
    """listings (uuid, bk, features, target): the least median of their features below target * (1 - gap)."""
    own = listings.select("uuid", "bk", "target", F.explode("features").alias("feature")).join(groups.select("bk", "feature", "median"), ["bk", "feature"])
    return own.where(F.col("median") < F.col("target") * (1 - gap)).groupBy("uuid").agg(F.min("median").alias("floor"))
