"""Stateful flows, replayed in several batches, against plain Python."""

import datetime as dt
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from stallkeeper.streaming import state

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def replay(spark, tmp_path, flow, batches, schema, name):
    """Rows of a flow over batches, one after the other and each with the query started anew."""
    folder, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    folder.mkdir()
    rows = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
        q = flow(stream).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return rows


def test_benched_products(spark, tmp_path):
    r = random.Random(1)
    prices = [("p", at(k), 100 * (1.3 if 40 <= k < 44 or k == 58 or 61 <= k < 63 else 1) + r.random(), 90.0 + r.random()) for k in range(80)]
    rows = replay(spark, tmp_path, state.benched, [prices[:35], prices[35:50], prices[50:], [("z", at(500), 1.0, 1.0)]], "product string, ts timestamp, ask double, bid double", "bench")
    until, expected = at(-1), []
    for k, (_, now, ask, bid) in enumerate(prices):
        before = [x for x in prices[:k] if x[1] >= now - dt.timedelta(minutes=30)]
        worst = max((state.moved(live, median(x[i] for x in before)) for i, live in ((2, ask), (3, bid))), default=0) if before else 0
        tripped = now >= until and worst > 10
        until = now + dt.timedelta(minutes=15) if tripped else until
        expected.append((now, tripped, now < until))
    got = sorted((x.ts, x.tripped, x.benched) for x in rows if x["product"] == "p")
    assert got == expected and sum(x[1] for x in got) == 2


def test_two_dumps_give_what_one_replay_gives(spark, tmp_path):
    r = random.Random(2)
    flips = [(r.choice(["s", "t", "", None]), r.choice("ab"), f"u{r.randrange(12)}", at(k)) for k in range(60)] + [("s", "a", "late", at(60 + 8 * 1440)), ("s", "a", "later", at(61 + 8 * 1440))]
    schema = "seller string, fk string, uuid string, ts timestamp"
    told, last, expected = {}, {}, []
    for seller, fk, uuid, ts in flips:
        key = (seller or "", fk)
        if key in last and ts - last[key] >= dt.timedelta(days=7):
            told[key] = set()
        own = told.setdefault(key, set())
        free = not seller or uuid in own or len(own) < 3
        if free and seller:
            own.add(uuid)
            last[key] = ts
        expected.append((ts, uuid, free))
    two = replay(spark, tmp_path, state.relists, [flips[:25], flips[25:60], [("x", "x", "x", at(60 + 8 * 1440 - 1))], flips[60:]], schema, "two")
    assert sorted((x.ts, x.uuid, x.passes) for x in two if x.seller != "x") == sorted(expected)
    assert any(not x[2] for x in expected) and expected[-1][2]


def test_nothing_is_released_early_or_lost(spark, tmp_path):
    second = lambda s: START + dt.timedelta(seconds=s)
    schema = "uuid string, price double, start timestamp, ts timestamp"
    batches = [[("a", 1.0, second(0), second(1)), ("old", 2.0, second(-60), second(1))], [("b", 3.0, second(10), second(12))], [("c", 4.0, second(100), second(25))], [("tick", 0.0, second(0), second(300))], [("tock", 0.0, second(0), second(301))]]
    seen = []
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate(batches):  # each start is a restart
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
        state.released(stream).writeStream.foreachBatch(lambda df, _: seen.extend((k, x.uuid, x.release) for x in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    first = {u: (k, t) for k, u, t in seen}
    assert sorted(u for _, u, _ in seen) == ["a", "b", "c", "old", "tick", "tock"]
    assert first["old"][0] == 0 and first["a"][0] >= 1 and first["b"][0] >= 2 and first["c"][0] >= 3
    assert first["a"][1] == second(18.5)


def test_orders_follow_scripts(spark, tmp_path):
    schema = "owner string, product string, ts timestamp, seq int, event string, units double, coins double"
    scripts = {
        "whole": [(0, "place", 10, 1000), (1, "buy_placed", 10, 1000), (5, "buy_filled", 10, 0), (6, "offer", 10, 1500), (9, "sell_filled", 10, 0), (12, "place", 5, 500), (45, "place", 5, 500), (46, "buy_placed", 4, 400)],
        "ghost": [(0, "place", 10, 1000), (11, "place", 10, 1000), (13, "place", 10, 1000), (30, "place", 10, 1000), (31, "buy_placed", 10, 1000)],
        "adopted": [(0, "buy_placed", 8, 800), (2, "buy_filled", 8, 0), (3, "offer", 8, 1200)],
        "dropped": [(0, "place", 3, 30), (1, "not_competitive", 0, 0), (2, "place", 3, 30), (3, "buy_placed", 3, 30), (4, "not_competitive", 0, 0), (5, "offer", 3, 60), (6, "sell_cancelled", 0, 0), (7, "offer", 3, 45), (8, "sell_filled", 1, 0)],
        "unknown": [(0, "sell_filled", 1, 0), (1, "buy_placed", 0, 0)],
    }
    events = sorted((("o", p, at(m), k, e, float(u), float(c)) for p, rows in scripts.items() for k, (m, e, u, c) in enumerate(rows)), key=lambda x: (x[2], x[1], x[3]))
    batches = [events[:9], events[9:16], events[16:], [("o", "tick", at(600), 0, "x", 0.0, 0.0)], [("o", "tick", at(601), 0, "x", 0.0, 0.0)]]
    rows = replay(spark, tmp_path, state.orders, batches, schema, "orders")
    story = lambda p: [(x.event, (x.ts - START) / dt.timedelta(minutes=1), x.units, round(x.net, 4)) for x in sorted((x for x in rows if x["product"] == p), key=lambda x: x.ts)]
    sold = round(10 * (150 * 0.9875 - 100), 4)
    assert story("whole") == [("placed", 0, 10, 0), ("confirmed", 1, 10, 0), ("filled", 5, 10, 0), ("offered", 6, 10, 0), ("sold", 9, 10, sold), ("closed", 9, 10, 0), ("refused", 12, 5, 0), ("placed", 45, 5, 0), ("confirmed", 46, 4, 0)]
    assert story("ghost") == [("placed", 0, 10, 0), ("phantom", 10, 10, 0), ("refused", 11, 10, 0), ("placed", 13, 10, 0), ("phantom", 23, 10, 0), ("placed", 30, 10, 0), ("confirmed", 31, 10, 0)]
    assert story("adopted") == [("adopted", 0, 8, 0), ("filled", 2, 8, 0), ("offered", 3, 8, 0), ("settled", 183, 8, round(8 * (150 * 0.9875 - 100), 4)), ("closed", 183, 8, 0)]
    assert [x[:2] for x in story("dropped")] == [("placed", 0), ("dropped", 1), ("placed", 2), ("confirmed", 3), ("offered", 5), ("sell_cancelled", 6), ("offered", 7), ("sold", 8), ("settled", 187 + 1), ("closed", 188)]
    assert story("unknown") == []
    assert [x.strikes for x in sorted((x for x in rows if x["product"] == "ghost"), key=lambda x: x.ts)] == [0, 1, 1, 1, 2, 2, 0]


def test_dumps_and_versions(spark, tmp_path):
    folder, source, told = str(tmp_path / "live"), tmp_path / "dumps", []
    source.mkdir()
    for k, names in enumerate(["abc", "abcd", "dde", "a"]):
        spark.createDataFrame([(c,) for c in names], "uuid string").coalesce(1).write.parquet(str(source / f"b{k}"))
        stream = spark.readStream.schema("uuid string").option("recursiveFileLookup", True).parquet(str(source))
        state.dumps(stream, folder, lambda df, n: told.append((n, sorted(x.uuid for x in df.collect()))), str(tmp_path / "ck"), primed_rows=2, once=True).awaitTermination(120)
    assert told == [(1, ["d"]), (2, ["e"])]  # nothing before the first dump, and two live rows are too few
    assert state.latest(spark, folder)[0] == 3 and state.latest(spark, folder, 2)[0] == 1
    index, prices = str(tmp_path / "index"), []
    assert state.latest(spark, index) is None
    for k in range(3):
        if k:
            state.publish(spark.createDataFrame([("a", float(k))], "uuid string, price double"), index, k, keep=1)
        stream = spark.readStream.schema("uuid string").option("recursiveFileLookup", True).parquet(str(source))
        spark.createDataFrame([("a",)], "uuid string").coalesce(1).write.parquet(str(source / f"c{k}"))
        state.priced_by_latest(stream, index, lambda df, own, n: prices.append((n, df.join(own, "uuid").agg(F.max("price")).first()[0])), str(tmp_path / "ck2"), once=True).awaitTermination(120)
    assert prices == [(1, 1.0), (2, 2.0)]
