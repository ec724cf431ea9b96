"""Ordered counts, dealing and picking against plain Python."""

import random

from pyspark.sql import functions as F

from stallkeeper.functions.counts import counts_below, counts_within
from stallkeeper.operators import filters, lanes


def test_counts_below_are_those_of_pairs(spark):
    r = random.Random(1)
    values = [(r.choice("ab"), float(r.randrange(40))) for _ in range(300)] + [("c", None)]
    probes = [(i, r.choice("abz"), float(r.randrange(-5, 45)) if i % 9 else float("inf")) for i in range(80)]
    v, p = spark.createDataFrame(values, "k string, price double"), spark.createDataFrame(probes, "id int, k string, x double")
    for keys in (["k"], []):
        for inclusive in (False, True):
            found = {x.id: (x.below, x.of) for x in counts_below(v, p, keys, "price", "x", inclusive).collect()}
            for i, k, x in probes:
                own = [y for q, y in values if y is not None and (not keys or q == k)]
                assert found[i] == (sum(y <= x if inclusive else y < x for y in own), len(own))
    assert counts_below(v.limit(0), p, [], "price", "x").where("below > 0 or of > 0").count() == 0


def test_competing_is_that_of_pairs(spark):
    r = random.Random(2)
    rows = [(f"u{i}", r.choice("xy"), float(r.randrange(1, 30)), float(r.randrange(1, 40))) for i in range(120)]
    df = spark.createDataFrame(rows, "uuid string, fk string, price double, resale double")
    found = {x.uuid: (x.undercuts, x.support) for x in lanes.competing(df.select("uuid", "fk", "price"), df).collect()}
    for u, k, _, resale in rows:
        others = [p for w, q, p, _ in rows if q == k and w != u]
        assert found[u] == (sum(p < resale for p in others), sum(p >= resale * 0.9 for p in others))


def test_round_robin_and_plans_for_a_small_purse(spark):
    flips = spark.createDataFrame([(i,) for i in range(50)], "n int")
    clients = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "client string, place int")
    assert {x.n: x.client for x in filters.round_robin(flips, clients, ["n"]).collect()} == {i: "abc"[i % 3] for i in range(50)}
    plans = spark.createDataFrame([(f"p{i}", 100.0, 50.0 - i) for i in range(8)] + [("cheap", 4.0, 1.0)], "tag string, cost double, score double")
    assert filters.greedy_plans(plans, [("poor", 5.0, 1)], 1) == [("poor", "cheap")]


def test_tiers_keep_repeated_rows(spark):
    flips = spark.createDataFrame([(1, "i", 5.0, 0.5, 0.5)] * 2 + [(2, None, 1.0, 0.1, 0.1)], "id int, item string, profit double, roi double, confidence double")
    rules = spark.createDataFrame([(1, "i", False, 1.0, 0.1, 0.1, 7, 0.9)], "rule_no int, item string, blacklist boolean, min_profit double, min_roi double, min_confidence double, priority int, scale double")
    assert sorted((x.id, x["pass"], x.scale) for x in filters.tiers(flips, rules, 9.0, 0.9).collect()) == [(1, True, 0.9), (1, True, 0.9), (2, False, None)]
    assert filters.tiers(flips, rules.limit(0), 0.5, 0.1).where(F.col("pass")).count() == 3


def test_counts_within_are_those_of_pairs(spark):
    r = random.Random(3)
    for size, spread in ((400, 5), (400, 1000), (3, 10)):
        values = [(float(r.randrange(spread)), float(r.randrange(spread))) for _ in range(size)] + [(None, 1.0), (1.0, None)]
        probes = [(i, r.choice([float("inf"), -5.0, float(r.randrange(spread))]), r.choice([float("-inf"), float("inf"), float(r.randrange(spread))])) for i in range(60)]
        v, p = spark.createDataFrame(values, "x double, y double"), spark.createDataFrame(probes, "id int, most double, floor double")
        found = {q.id: (q.upto, q.within) for q in counts_within(v, p, "x", "most", "y", "floor", "id").collect()}
        known = [(x, y) for x, y in values if x is not None and y is not None]
        assert {i: w for i, (_, w) in found.items()} == {i: sum(x <= most and y < floor for x, y in known) for i, most, floor in probes}
        assert {i: u for i, (u, _) in found.items()} == {i: sum(x <= most for x, _ in known) for i, most, _ in probes}


def test_hot_keys_are_counted_by_ranges(spark):
    r = random.Random(4)
    values = [("hot", float(int(2 ** r.uniform(0, 30))), r.randrange(3)) for _ in range(2000)] + [("x", 1.0, 1)]
    probes = [(i, r.choice(["hot", "x", "none"]), r.choice([float("inf"), float(int(2 ** r.uniform(0, 31)))])) for i in range(50)]
    v, p = spark.createDataFrame(values, "k string, price double, n int"), spark.createDataFrame(probes, "id int, k string, at double")
    found = {x.id: (x.below, x.of) for x in counts_below(v, p, ["k"], "price", "at", weight="n", split=True).collect()}
    assert found == {i: (sum(n for q, y, n in values if q == k and y < x), sum(n for q, _, n in values if q == k)) for i, k, x in probes}
