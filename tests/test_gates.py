"""Gates and messages by hand."""

import random

from pyspark.sql import functions as F

from stallkeeper.operators import gates, ledger


def test_trade_messages(spark):
    lines = ["[Bazaar] Buy Order Setup! 2,571x  Copper  Ore for 340,015 coins.", "Your Buy Order for 64x Coal was filled!", "You reached your maximum of 1,400 orders", "Your price isn't competitive", "hello", "", None]
    found = [tuple(r.m) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", gates.trade_message(F.col("line")).alias("m")).orderBy("i").collect()]
    assert found[0] == ("buy_placed", 2571.0, "Copper Ore", 340015.0)
    assert found[1] == ("buy_filled", 64.0, "Coal", None)
    assert found[2][:2] == ("max_orders", 1400.0) and found[3][0] == "not_competitive"
    assert [x[0] for x in found[4:]] == [None] * 3


def test_client_floor_of_a_big_purse_and_a_full_inventory(spark):
    rows = [(1, 9, 1, 1e6, False, 0, 10.0, 5000.0), (2, 0, 1, 1e6, False, 0, 10.0, 5e4), (3, 9, 1, 1e5, True, 30, 10.0, 5000.0), (4, 9, 1, 1e5, False, 30, 10.0, 5000.0), (5, 9, 1, 100.0, False, 0, 90.0, 5000.0), (6, None, None, None, None, None, 10.0, 5000.0), (7, 3, 1, 1e5, None, None, 10.0, 5000.0)]
    df = spark.createDataFrame(rows, "id int, free int, auctions int, purse double, at_limit boolean, used int, price double, profit double")
    found = {r.id: r.why for r in df.select("id", gates.ineligible(2, 14, 0.5, 0.02, 2e5, 8000, 20, 3).alias("why")).collect()}
    assert found == {1: "floor", 2: "slots", 3: "full", 4: None, 5: "purse", 6: None, 7: "full"}


def test_counts_of_clients_are_those_of_each_flip(spark):
    """Flips whose profit has nothing to do with their price, clients of every kind, against one decision after the other."""
    r = random.Random(6)
    flips = [(float(r.randrange(1, 300)), float(r.randrange(12000))) for _ in range(250)] + [(10.0, 9000.0), (100.0, 1.0)]
    clients = [(i, r.choice([0, 1, 2, 5]), r.randrange(18), float(r.choice([0, 120, 400, 5000, 250_000, 900_000])), r.choice([True, False, None]), r.choice([None, 0, 19, 25])) for i in range(60)]
    f, c = spark.createDataFrame(flips, "price double, profit double"), spark.createDataFrame(clients, "client int, free int, auctions int, purse double, at_limit boolean, used int")
    for limits in ((2, 14, 0.5, 0.02, 200_000, 8000, 20, 3), (0, 0, 0, 0, 0, 0, 0, 0), (0, 14, 1.0, 0.001, 0, 8000, 20, 1)):
        each = c.crossJoin(f).select("client", F.coalesce(gates.ineligible(*limits), F.lit("passed")).alias("reason")).groupBy("client", "reason").count()
        assert {tuple(x) for x in gates.client_reasons(f, c, *limits).collect()} == {tuple(x) for x in each.collect()}


def test_routes_of_empty_and_repeated_rows(spark):
    schema = "uuid string, bin boolean, price double, item_bytes string"
    empty = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([("a", True, 1.0, "x"), ("a", True, 1.0, "x"), ("b", None, 1.0, "x"), ("c", True, 1.0, None)], schema)
    assert gates.route(empty, rows).count() == 0
    assert sorted((r.uuid, r.route) for r in gates.route(rows, empty).collect()) == [("a", "new"), ("a", "new"), ("b", "skip"), ("c", "skip")]
    assert sorted(r.route for r in gates.route(rows, rows).collect()) == ["old", "old", "old", "skip"]


def test_best_orphan(spark):
    h = spark.createDataFrame([("x", "a", 2.0), ("x", "b", 1.0), ("y", "a", 1.0)], "owner string, product string, units double")
    prices = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "product string, price double")
    assert [tuple(r) for r in ledger.best_orphan(h, h.where("owner = 'y'"), prices).collect()] == [("x", "a", 6.0)]


def test_base_decision_order(spark):
    rows = [(1, "a", 1.0, None), (2, "bad", 9.0, "x"), (3, "a", 9.0, "risky,thin"), (4, "a", 9.0, None), (5, "a", 9.0, "x")]
    df = spark.createDataFrame(rows, "id int, item string, profit double, guard string")
    found = df.select("id", gates.base_decision(5, ["Bad"], F.col("id") < 5, ["thin", ""]).alias("why"))
    assert {r.id: r.why for r in found.collect()} == {1: "hard", 2: "blacklist", 3: "guard", 4: None, 5: "tiers"}
