"""Features are learned by counts on either side of a bar, and keys take them from short lists."""

import random

import pytest

from stallkeeper.operators import index, products
from stallkeeper.plans import items, views

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_learned_features_are_those_by_medians(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice("ab"), float(r.choice([1, 2, 3, 5, 6, 7, 40])), r.sample("uvwxyz", r.randrange(4))) for k in range(r.choice([40, 41, 300]))] + [(900, "c", None, ["u"]), (901, "d", 4.0, ["u"]), (902, None, 4.0, ["u"])]
    sales = spark.createDataFrame(rows, "sale_id long, bk string, price double, features array<string>")
    for share in (0.5, 1.0, 2.0, 2.5):
        c = views.CONFIG.__class__(min_share=share, min_samples=3)
        base = index.base_stats(sales)
        expected = {(x.bk, x.feature) for x in index.significant(index.feature_groups(sales), base, c).collect()}
        found = index.feature_tests(sales, base, c).collect()
        assert {(x.bk, x.feature) for x in found if x.learned} == expected
        assert {(x.bk, x.feature) for x in found} == {(bk, f) for _, bk, _, fs in rows for f in fs}


def test_items_are_neither_exploded_nor_gathered(spark):
    own = spark.createDataFrame([(1, "A", ["x", "y", "x", "z"], 7), (2, "A", ["y"], 8), (3, "B", [], 9), (4, "B", None, 9), (5, None, ["x"], 9)], "id long, bk string, tokens array<string>, price int")
    values = spark.createDataFrame([("x", 10.0), ("y", 900000.0), ("z", None)], "token string, value double")
    base = spark.createDataFrame([("A", 100.0)], "bk string, base_value double")
    found = products.keys_and_minor(own, values, base, spark.createDataFrame([("A", "z")], "bk string, feature string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    assert sorted((r.id, r.bk, r.price, r.fk, r.minor) for r in found.collect()) == [(1, "A", 7, "A#y+z", 20.0), (2, "A", 8, "A#y", 0.0), (3, "B", 9, "B", 0.0), (4, "B", 9, "B", 0.0), (5, None, 9, None, 0.0)]


@pytest.mark.parametrize("name", ["p5", "p4_minor"])
def test_no_prices_are_sorted_to_learn(spark, monkeypatch, name):
    plans, write = {}, items.materialised
    monkeypatch.setattr(items, "materialised", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name))
    last = getattr(items, name)(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in last and "Window" not in plans["tests"]
