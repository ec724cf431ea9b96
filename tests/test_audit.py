"""Rejected listings against realised prices, and own purchases for sale."""

import pytest

from stallkeeper.operators import audit

LOG, SALES = "uuid string, fk string, price double, reference double", "fk string, price double"


def test_missed(spark):
    sales = spark.createDataFrame([("a", p) for p in (50.0, 100.0, 120.0, 900.0)] + [("b", 1.0), ("b", 2.0), ("b", None)], SALES)  # upper median of a: 120
    log = spark.createDataFrame([("1", "a", 100.0, 110.0), ("2", "a", 115.0, None), ("3", "b", 1.0, 4.0), ("4", "c", 1.0, 0.5), ("5", "a", 0.0, 9.0), ("6", "a", None, 9.0)], LOG)
    found = {r.uuid: r for r in audit.missed(log, sales).collect()}
    assert {u: r.outcome for u, r in found.items()} == {"1": "won", "2": "lost", "3": "unknown", "4": "unknown"}
    assert found["1"].gain == pytest.approx(120 * 0.9888 - 100) and found["1"].margin == pytest.approx(10 / 110) and found["2"].margin is None
    bands = {r.band: r for r in audit.by_margin(audit.missed(log, sales), [0.0, 0.5]).collect()}
    assert {b: (r.n, r.known, r.won, r.lost) for b, r in bands.items()} == {1: (1, 1, 1, 0), None: (1, 1, 0, 1), 2: (1, 0, 0, 0), 0: (1, 0, 0, 0)}
    assert bands[None].spared == pytest.approx(abs(120 * 0.9888 - 115)) and bands[None].gained == 0
    assert audit.by_margin(audit.missed(log.limit(0), sales.limit(0)), [0.0]).count() == 0


def test_own_relists(spark):
    listings = spark.createDataFrame([("l1", "i1"), ("l2", "i1"), ("l3", "i2"), ("l4", None), ("l5", "i3")], "uuid string, item_uuid string")
    bought = spark.createDataFrame([("f1", "i1", 1.0), ("f2", "i1", 2.0), ("f3", "i2", 1.0), ("f4", None, 9.0)], "flip string, item_uuid string, bought_at double")
    basis = spark.createDataFrame([("i1",), ("i1",), ("i3",)], "item_uuid string")
    assert {tuple(r) for r in audit.own_relists(listings, bought, basis).collect()} == {("l1", "i1", "f2"), ("l2", "i1", "f2")}
