"""Tier decisions, listing prices, estimates and market orders against plain Python, row by row."""

import math
import random
from dataclasses import replace

import pytest

from stallkeeper.config import Pricing
from stallkeeper.operators import asking, buying, index, tiering
from stallkeeper.plans.pricing import RULES

FLIP = "id int, item string, fields map<string,double>, profit double, roi double, confidence double, volume double, fair_tts_ms double, tts_samples int, sell_through double"


def decision(f, rules, c):
    """pass, scale, priority of one flip, and the kind of its reason."""

    def holds(field, want):
        x = f["fields"].get(field)
        return x is not None and (want[0] <= x <= want[1] if len(want) == 2 else x in want)

    def rate(r):
        if r["min_profit"] is not None and f["profit"] < r["min_profit"]:
            return "profit"
        if r["min_roi"] is not None and f["roi"] < r["min_roi"]:
            return "roi"
        if r["min_confidence"] is not None and f["confidence"] < r["min_confidence"] and not extreme:
            return "conf"
        quick = measured is not None and r["max_sell_ms"] is not None and measured <= r["max_sell_ms"]
        if r["min_volume"] is not None and not extreme and not quick and (f["volume"] is None or f["volume"] < r["min_volume"]):
            return "vol"
        return "too slow" if r["max_sell_ms"] is not None and expected is not None and expected > r["max_sell_ms"] else None

    asked = [r for scope in ("GLOBAL", f["item"]) for r in rules if r["item"] == scope and all(holds(*m) for m in (r["matcher"] or {}).items())]
    extreme = c.extreme_profit > 0 and f["profit"] >= c.extreme_profit and f["roi"] >= c.extreme_roi
    sure = c.min_sell_through <= 0 if f["sell_through"] is None else f["sell_through"] >= c.min_sell_through
    measured = f["fair_tts_ms"] if c.measured_times and sure and f["fair_tts_ms"] and (f["tts_samples"] or 0) >= c.min_times else None
    expected = measured or (tiering.DAY_MS / f["volume"] if f["volume"] else None)
    if any(r["kind"] == "blacklist" for r in asked):
        return False, 1.0, 0.0, "blacklisted"
    rated = [(rate(r), r) for r in asked if r["kind"] == "consider"]
    fine = [r for why, r in rated if why is None]
    if fine:
        best = max(fine, key=lambda r: r["priority"] or 0.0)  # the first of equals
        return True, 1.0 if best["scale"] is None else best["scale"], best["priority"] or 0.0, None
    if f["profit"] >= c.min_profit and f["roi"] >= c.min_roi and f["confidence"] >= c.min_confidence and (f["volume"] is None or f["volume"] >= c.min_volume):
        return True, c.scale, 0.0, None
    return False, 1.0, 0.0, next((why for why, _ in reversed(rated)), "below global")


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions(spark, seed):
    rng = random.Random(seed)
    maybe = lambda x, p=0.3: None if rng.random() < p else x
    some = lambda *xs: maybe(rng.choice(xs))
    flips = [
        {"id": i, "item": rng.choice("ABC"), "fields": {k: float(rng.randint(0, 3)) for k in rng.sample(["stars", "gems", "x"], 2)}, "profit": rng.choice([1e3, 2e4, 3e5, 2.5e6]), "roi": float(rng.randint(0, 60)), "confidence": rng.random(),
         "volume": some(0.0, 0.5, 4.0), "fair_tts_ms": some(1e6, 9e7, 9e8), "tts_samples": some(2, 9), "sell_through": some(0.1, 0.9)}
        for i in range(400)
    ]
    wants = [None, {}, {"stars": [1.0, 2.0]}, {"gems": [0.0, 1.0, 3.0]}, {"x": [2.0]}, {"stars": [0.0, 3.0], "gems": [1.0]}, {"x": []}]
    rules = [
        {"rule_no": i, "item": rng.choice(["GLOBAL", "A", "B"]), "kind": rng.choice(["consider"] * 5 + ["blacklist", None]), "matcher": rng.choice(wants), "min_profit": some(1e4, 1e6), "min_roi": some(12.5, 30.0), "min_confidence": some(0.2, 0.6),
         "min_volume": some(1.0, 2.5), "max_sell_ms": some(5e6, 2e8), "priority": some(1.0, 1.0, 4.0), "scale": some(0.9, 0.95)}
        for i in range(12)
    ]
    for r in rules:
        if r["kind"] == "blacklist" and not r["matcher"]:
            r["matcher"] = {"stars": [3.0]}
    c = tiering.Limits(min_profit=2e4, min_roi=40, min_confidence=0.5, min_volume=0.4, extreme_profit=1e6, extreme_roi=30, measured_times=seed == 1, min_sell_through=0.5 * (seed == 1))
    found = tiering.decide(spark.createDataFrame(flips, FLIP), spark.createDataFrame([tuple(r.values()) for r in rules], RULES), c).collect()
    assert len(found) == len(flips)
    kinds = set()
    for row in found:
        ok, scale, priority, why = decision(flips[row.id], rules, c)
        assert (row["pass"], row.scale, row.priority) == (ok, scale, priority), (flips[row.id], row)
        assert row.reason is None if why is None else row.reason.startswith(why), (row, why)
        kinds.add(why)
    assert len(kinds) > 4


def test_decisions_without_rules_or_values(spark):
    flips = [(1, "A", None, 5e4, 50.0, 0.9, None, None, None, None), (2, None, {}, None, None, None, None, None, None, None)]
    found = tiering.decide(spark.createDataFrame(flips, FLIP), spark.createDataFrame([], RULES), tiering.Limits(min_profit=1e4)).collect()
    assert {r.id: (r["pass"], r.scale) for r in found} == {1: (True, 0.97), 2: (False, 1.0)}
    assert tiering.decide(spark.createDataFrame([], FLIP), spark.createDataFrame([], RULES), tiering.Limits()).count() == 0


def test_reason_texts(spark):
    rules = [(1, "GLOBAL", "consider", None, 1.5e6, None, None, None, None, None, None), (2, "B", "consider", None, None, 12.5, None, None, None, None, None), (3, "C", "consider", None, None, None, None, 3.0, None, None, None)]
    flips = [(i, item, {}, 4e4, 9.0, 0.25, 1.0, None, None, None) for i, item in enumerate("ABC")]
    found = tiering.decide(spark.createDataFrame(flips, FLIP), spark.createDataFrame(rules, RULES), tiering.Limits(min_profit=1e9)).orderBy("id")
    assert [r.reason for r in found.collect()] == ["profit<1.5M", "roi<12.5%", "vol<3"]
    found = tiering.decide(spark.createDataFrame(flips[:1], FLIP), spark.createDataFrame([], RULES), tiering.Limits(min_profit=1e9)).head()
    assert found.reason == "below global (profit 40k, roi 9%, conf 25%) and no tier matched"


HELD = "id int, target double, lbin double, basis string, paid double, acquired_ms double, first_seen_ms double, volume_per_day double, market_median double, variant_priced boolean, failed double"
NOW = 1e12


def price(h, c):
    start_at = next((x for x in (h["acquired_ms"], h["first_seen_ms"]) if x is not None), NOW)
    age, lbin, median = max(NOW - start_at, 0.0), h["lbin"] or 0.0, h["market_median"] or 0.0
    start = (c.niche_h if h["volume_per_day"] is not None and h["volume_per_day"] <= 1 else c.start_h) * asking.HOUR_MS
    days = -1.0 if age < start else (age - start) // (24 * asking.HOUR_MS) + c.fail_days * min(max(h["failed"] or 0.0, 0.0), c.most_fails)
    floor = 0.0
    if h["paid"] and not (c.give_up_days > 0 and days >= c.give_up_days):
        floor = math.ceil(h["paid"] * (1 + (max(0.05 - 0.03 * (days + 1), -0.10) if days >= 0 else 0.05)))

    def follow(ask):
        if not c.follow or lbin <= 0:
            return ask
        bound = math.floor(lbin * 0.995)
        if median > 0 and c.lowball_guard > 0:
            bound = max(bound, math.floor(median * c.lowball_guard))
        return min(ask, max(bound, math.floor(h["target"] * 0.9)))

    if age >= start:
        decay = min(0.02 * (days + 1), 0.25)
        ask, mode = math.floor(h["target"] * (1.05 - decay)), "clearance-no-lbin"
        if lbin > 0:
            ask, mode = max(min(follow(math.inf), math.floor(lbin)), 0 if decay >= 0.25 else math.floor(h["target"] * 0.9)), "clearance-market"
    else:
        mode, model = "normal", h["basis"] == "model"
        ask = math.floor(h["target"] * (0.97 if model else 1.05))
        if lbin and model:
            ask = max(math.floor(lbin * 0.995), math.floor(h["target"] * 0.9))
        elif lbin >= h["target"] * 0.92:
            ask = min(math.floor(lbin * 0.995), math.floor(h["target"] * 1.25))
        ask = follow(ask)
    if c.market_cap > 0 and not h["variant_priced"] and median > 0:
        ask = min(ask, math.floor(median * c.market_cap))
        if c.cap_over_lbin and lbin > median:
            ask = max(ask, math.floor(lbin - 1))
    return max(ask, floor), floor, mode


@pytest.mark.parametrize("c", [asking.Asking(), asking.Asking(follow=True), asking.Asking(follow=True, lowball_guard=0, market_cap=1.1, fail_days=2, give_up_days=4), asking.Asking(market_cap=0.9, cap_over_lbin=True)])
def test_listing_prices(spark, c):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice((None, *xs))
    held = [
        {"id": i, "target": t, "lbin": pick(t * 0.5, t * 0.93, t * 1.1, t * 1.4), "basis": pick("model", "refs"), "paid": pick(0.0, t * 0.7, t * 1.3), "acquired_ms": pick(NOW - 4e6, NOW - 3e7, NOW - 3e8, NOW - 3e9, NOW + 1e6),
         "first_seen_ms": pick(NOW - 1e8), "volume_per_day": pick(0.5, 7.0), "market_median": pick(t * 0.8, t * 1.5), "variant_priced": pick(True, False), "failed": pick(0.0, 3.0, 40.0)}
        for i, t in enumerate(rng.uniform(1e3, 1e6) for _ in range(300))
    ]
    rows = asking.listing_prices(spark.createDataFrame(held, HELD), NOW, c).collect()
    assert {r.id: (r.list_at, r.cost_floor, r.mode) for r in rows} == {h["id"]: price(h, c) for h in held}
    assert len({r["mode"] for r in rows}) == 3


def test_estimates_use_sources_in_turn(spark):
    items = spark.createDataFrame([(i, b, f, [f, b], m) for i, b, f, m in [(1, "a", "a#x", 9000.0), (2, "b", "b#x", None), (3, "c", "c", 0.0), (4, "d", "d", 0.0), (5, "e", "e", 0.0), (6, "f", "f", 0.0)]], "id int, bk string, fk string, rungs array<string>, minor double")
    cells = "target double, volume_per_day double, confidence double, samples bigint"
    stats = spark.createDataFrame([("a#x", 1000.0, 1.234, 0.9, 9), ("a", 1.0, 1.0, 1.0, 1), ("b", 500.0, 2.0, 0.8, 6)], f"fk string, {cells}")
    modelled = spark.createDataFrame([(1, 7.0, 7.0, 0.7, 7), (3, 70.4, 7.0, 0.7, 7)], f"id int, {cells}")
    listings = spark.createDataFrame([("d", 400.0), ("d", 300.0), ("e", 9000.0), ("c", 1.0)], "fk string, price double")
    base = spark.createDataFrame([("d", 100.0, 30), ("e", 100.0, 30), ("a", 80.0, 3)], "bk string, base_value double, n bigint")
    found = {r.id: r for r in asking.estimates(items, stats, modelled, listings, base, Pricing(), lbin_cap=2).collect()}
    assert {i: (r.basis, r.target, r.samples, r.lbin, r.market_median) for i, r in found.items()} == {1: ("refs", 1300.0, 9, None, None), 2: ("ladder", 500.0, 6, None, None), 3: ("model", 70.0, 7, 1.0, None), 4: ("lbin", 200.0, 2, 300.0, 100.0)}
    assert (found[1].volume_per_day, found[2].confidence, found[1].variant_priced, found[3].variant_priced) == (1.23, 0.68, True, False)


PRODUCT = "product string, name string, ask double, bid double, buy_week double, sell_week double, ask_levels array<struct<price:double,amount:double>>, quarantined boolean, holding boolean, resting boolean"
STATS = "product string, samples int, bid_median double, ask_median double, median_ratio double, stability double, undercut_per_hour double, vol_pct double"
GOOD = {"name": "Thing", "ask": 120.0, "bid": 100.0, "buy_week": 7e4, "sell_week": 7e5, "ask_levels": [(120.0, 10.0), (121.0, 5000.0)], "quarantined": False, "holding": None, "resting": None}
HISTORY = {"samples": 100, "bid_median": 100.0, "ask_median": 120.0, "median_ratio": 1.2, "stability": 0.9, "undercut_per_hour": 3.0, "vol_pct": 1.0}


def test_buy_gates(spark):
    cases = {
        "already holding": {"holding": True, "bid": 0.0}, "closed too recently": {"resting": True}, "blacklisted": {}, "quarantined": {"quarantined": True}, "one-sided book": {"bid": 0.0}, "unit price below floor": {"bid": 4.0}, "no history": {}, "history too thin": {"samples": 59},
        "price moved too far, too fast": {"ask_median": 90.0}, "book too wide right now": {"ask": 301.0, "ask_median": 301.0}, "book too wide to be real": {"median_ratio": 3.1}, "spread not persistent": {"stability": 0.4}, "outbid too often": {"undercut_per_hour": 61.0}, "flow too thin on one side": {"buy_week": 69.0},
        "no display name": {"name": None}, "cannot afford one unit": {"ask": 5e6, "bid": 4e6, "bid_median": 4e6, "ask_median": 5e6}, "sell side too thin for this size": {"ask_levels": [(120.0, 63.0)]}, "no margin after tax": {"ask": 101.0, "ask_median": 101.0, "ask_levels": []},
        "margin below floor": {"ask": 104.0, "ask_median": 104.0, "ask_levels": None}, "too volatile for the margin": {"vol_pct": 30.0}, "placed": {},
    }
    own = {reason: GOOD | {k: v for k, v in x.items() if k in GOOD} for reason, x in cases.items()}
    products = spark.createDataFrame([(r, *x.values()) for r, x in own.items()] + [("ENCHANTMENT_A", *GOOD.values())], PRODUCT)
    stats = spark.createDataFrame([(r, *(HISTORY | {k: v for k, v in cases.get(r, {}).items() if k in HISTORY}).values()) for r in [*cases, "ENCHANTMENT_A"] if r != "no history"], STATS)
    c = buying.Buying(blacklist=("blacklisted",), min_unit_price=5, moved_pct=20, min_flow=10, max_coins=1e6, reserve=2)
    plans = buying.buy_plans(products, stats, 1e6, 12, c)
    found = {r["product"]: r for r in plans.collect()}
    assert {p: r.reason or "placed" for p, r in found.items() if p != "ENCHANTMENT_A"} == {r: r for r in cases}
    placed, book = found["placed"], found["ENCHANTMENT_A"]
    assert (placed.buy_at, placed.units, book.units) == (100.1, 640.0, 10.0)  # ten slots of 64, or of one
    assert placed.exit_at == pytest.approx(119.9) and placed.score == pytest.approx((placed.exit_at * 0.9875 - 100.1) * 640 * 0.55 * 0.32 / 1.995)
    assert {r["product"] for r in buying.buy_plans(products, stats, 1e6, 2, c).where("reason = 'no inventory slot for this buy'").collect()} >= {"placed", "cannot afford one unit"}
    assert [r["product"] for r in buying.ranked(plans, 1).collect()] == ["placed"]
    assert {r.reason: r.n for r in buying.rejected(plans).collect()} == {r: 1 + (r == "placed") for r in cases}


def test_sell_plans(spark):
    positions = spark.createDataFrame([(1, "a", 100.0, 10.0), (2, "a", 119.0, 1.0), (3, "b", 1.0, 1.0), (4, "c", 1.0, 1.0)], "id int, product string, buy_price double, units double")
    found = {r.id: r for r in buying.sell_plans(positions, spark.createDataFrame([("a", 120.0), ("b", 0.0)], "product string, ask double"), buying.Buying()).collect()}
    assert [found[i].reason for i in (1, 2, 3, 4)] == [None, "ask below break-even", "no ask side", "no ask side"]
    assert found[1].offer == pytest.approx(119.9) and found[1].score == pytest.approx((119.9 * 0.9875 - 100) * 10 / 1.78)


def test_recent_medians(spark):
    ticks = spark.createDataFrame([("a", float(t), 10.0 + t, 5.0 + t) for t in range(10)], "product string, ts double, ask double, bid double")
    assert [tuple(r) for r in buying.recent_medians(ticks, 9, 2).collect()] == [("a", 13.0, 18.0)]


def test_targets(spark):
    """Widened windows, a falling base key, better stars and slow items, each where it applies."""
    day = 86400.0
    rows = [(f"{k}{i}", k, "b", "slow" if k == "s" else "i", 100.0 + i, 1e9 - age * day - i, f"p{i}") for k, age in [("w", 2), ("t", 5), ("c", 0.1), ("s", 0.1)] for i in range(5)]
    sales = spark.createDataFrame(rows, "sale_id string, fk string, bk string, item string, price double, sold_at double, seller string")
    trends = spark.createDataFrame([("b", -0.2)], "bk string, trend_pct double")
    caps = spark.createDataFrame([("c", 90.0), ("w", 500.0)], "fk string, cap double")
    slow = spark.createDataFrame([("slow", 0.2)], "item string, sell_through double")
    c = replace(Pricing(), short_hours=24)
    found = {r.fk: r for r in index.key_stats(sales, 1e9, c, widen=(72,), trends=trends, caps=caps, sell_through=slow).collect()}
    assert {k: round(r.target, 6) for k, r in found.items()} == {"w": 102.0, "t": 81.6, "c": 90.0, "s": 102 * 0.85}
    assert {k: round(r.trend_pct, 6) for k, r in found.items()} == {"w": 0.0, "t": -0.2, "c": 0.0, "s": 0.0}
    plain = {r.fk: r.target for r in index.key_stats(sales, 1e9, c).collect()}
    assert plain == {k: 102.0 for k in "wtcs"}
    assert index.key_stats(sales.limit(0), 1e9, c, trends=trends, caps=caps, sell_through=slow).count() == 0
