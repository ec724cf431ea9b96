"""Queries that read keyed sales more than once join and key them once."""

import pytest

from stallkeeper.plans import inventory, pricing, queries  # noqa: F401 (the others register more)
from stallkeeper.operators import index
from stallkeeper.plans import views

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["J1_price_lookup", "A19_binding_floor", "J7_key_ladder", "X6_prescreen", "L2_L3_graded", "F_estimates"])
def test_sales_are_put_together_once(spark, monkeypatch, name):
    made = []
    sales = views.sales
    monkeypatch.setattr(views, "sales", lambda *args: made.append(args) or sales(*args))
    queries.QUERIES[name](spark, DIR)
    assert len(made) == 1


def test_readers_of_keyed_sales_do_not_learn_keys_again(spark):
    own = views.sales(spark, DIR)
    learned = index.significant(index.feature_groups(own), index.base_stats(own), views.CONFIG)
    plan = index.with_final_key(own, learned)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_sales_are_neither_exploded_nor_sorted_to_shuffle_features(spark, monkeypatch):
    monkeypatch.setattr(index, "feature_groups", lambda *_: pytest.fail("medians of every feature"))
    assert views.keyed_sales(spark, DIR).where("fk <> bk").count() > 0


def test_targets_read_sales_once(spark, monkeypatch):
    made, sales, names, write = [], views.sales, [], pricing.materialised
    monkeypatch.setattr(views, "sales", lambda *args: made.append(args) or sales(*args))
    monkeypatch.setattr(pricing, "materialised", lambda df, name, **how: names.append(name) or write(df, name, **how))
    queries.QUERIES["A9_targets"](spark, DIR)
    assert len(made) == 1 and "keyed" not in names
