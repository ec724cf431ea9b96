"""Inserting sold rows: the ids of a task are bounded, however many rows there are."""

from stallkeeper.operators import ledger
from stallkeeper.plans import queries


def test_tasks_grow_with_rows(spark, monkeypatch):
    found = {}
    for most in (10**9, 1000):
        monkeypatch.setattr(ledger, "TASK_ROWS", most, raising=False)
        df = queries.QUERIES["K1_insert_sold"](spark, "/root/testdata/sf0.001")
        found[most] = df.rdd.getNumPartitions(), sorted(map(str, df.collect()))
    assert found[1000][0] >= 5  # 6000 lines
    assert found[1000][1] == found[10**9][1]
