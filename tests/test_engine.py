"""Hand-computed cases, brute force on random data, sources and streams."""

import base64
import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from stallkeeper.config import Lanes, Pricing
from stallkeeper.functions import keys as k
from stallkeeper.functions import orderstats as o
from stallkeeper.functions import valuation as v
from stallkeeper.operators import filters, index, lanes, survival
from stallkeeper.sources import item_bytes, readers
from stallkeeper.streaming import flows


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_percentile_rules(spark):
    xs = F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4, 10, 11)))
    assert value(spark, o.rank_percentile(xs, 0.75)) == 4.0
    assert value(spark, o.upper_median(xs)) == 4.0


@pytest.mark.parametrize("through", [None, 0.0, 0.1, 0.45, 0.69, 0.71, 1.0])
def test_liquidity_factor(spark, through):
    """Linear below the pivot, between the floor and 1."""
    expected = 1.0 if through is None else max(0.6, min(1.0, 1 - 0.5 * (0.7 - through)))
    assert value(spark, v.liquidity_factor(F.lit(through).cast("double"), 0.7, 0.5, 0.6)) == pytest.approx(expected)


@pytest.mark.parametrize(
    ("buy", "resale", "n", "per_day", "bar", "margin", "passes"),
    [
        (80e6, 110e6, 15, 2.0, 20e6, 0.25, True),
        (80e6, 110e6, 15, 2.0, 20e6, 0.28, False),  # 30 of 110 lie between; after tax and over cost it would be 34 percent
        (95e6, 110e6, 15, 2.0, 5e6, 0.13, True),  # 13.6 percent before tax, 12.9 over cost after it
        (80e6, 110e6, 9, 2.0, 20e6, 0.25, False), (80e6, 110e6, 15, 0.9, 20e6, 0.25, False), (80e6, 110e6, 15, 2.0, 28e6, 0.25, False), (80e6, 110e6, 15, 2.0, 0.0, 0.25, False), (0.0, 110e6, 15, 2.0, 1.0, 0.0, False), (-5.0, 0.0, 15, 2.0, 1.0, 0.0, False),
    ],
)
def test_big_ticket(spark, buy, resale, n, per_day, bar, margin, passes):
    assert value(spark, v.big_ticket(F.lit(buy), F.lit(resale), F.lit(n), F.lit(per_day), bar, margin)) is passes


def test_keys(spark):
    assert value(spark, k.base_key(F.lit("SWORD"), F.lit(5.0), F.lit(2), F.lit("dye=red"))) == "SWORD*5x2~dye=red"
    assert value(spark, k.base_key(F.lit("SWORD"), F.lit(0.0), F.lit(1), F.lit(""))) == "SWORD"
    assert value(spark, k.strip_stars(F.lit("SWORD*5~v"))) == "SWORD~v"
    assert value(spark, k.book_key(F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.5)))) == "BOOK:a=1.5,b=2"
    assert value(spark, k.book_key(F.lit(None).cast("map<string,double>"))) == "BOOK:plain"
    assert value(spark, k.final_key(F.lit("x"), F.array(F.lit("b"), F.lit("a")))) == "x#a+b"
    assert value(spark, k.lore_weight(F.lit("§7Current §aweight: §e1,250"))) == 1250
    assert value(spark, k.lore_weight(F.lit("none"))) is None
    assert value(spark, k.clean_name(F.lit("§6Sword §7of "))) == "Sword of"


def test_multisets(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, o.multiset_contains(arr("a", "a", "b"), arr("a", "a")))
    assert not value(spark, o.multiset_contains(arr("a", "b"), arr("a", "a")))


def test_kaplan_meier_by_hand(spark):
    events = spark.createDataFrame([("i", float(t)) for t in (1, 2, 3, 4)], "item string, t double")
    none = events.limit(0)
    for horizon, share in ((2, 0.5), (4, 1.0)):
        assert survival.sell_through(survival.curve(events, none), horizon).first().sell_through == pytest.approx(share)
    both = survival.curve(events, spark.createDataFrame([("i", 2.0), ("only", 1.0)], "item string, t double")).collect()
    assert {(r["item"], r.t): round(r.survival, 6) for r in both} == {("i", 1.0): 0.8, ("i", 2.0): 0.6, ("i", 3.0): 0.3, ("i", 4.0): 0.0, ("only", 1.0): 1.0}


def test_listing_price_stays_over_cost(spark):
    rows = [(100.0, 90.0, False, 10.0, 1.0, 5.0), (100.0, None, True, 10.0, 200.0, 5.0), (100.0, 95.0, False, 300.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "target double, lbin double, learned boolean, paid double, age double, vol double")
    ask, mode = v.listing_price(*map(F.col, df.columns))
    assert [(r.a, r.m) for r in df.select(ask.alias("a"), mode.alias("m")).collect()] == [(105.0, "open"), (79.0, "clearance"), (315.0, "cost_floor")]


def test_price_at_depth(spark):
    levels = F.array(*(F.struct(F.lit(p).alias("price"), F.lit(a).alias("amount")) for p, a in ((1.0, 5.0), (2.0, 5.0), (3.0, 5.0))))
    assert [value(spark, v.price_at_depth(levels, F.lit(n))) for n in (5.0, 5.5, 15.0, 16.0)] == [1.0, 2.0, 3.0, None]


def test_throttle_is_that_of_a_sequence(spark):
    r = random.Random(8)
    flips, listings = [], []
    for i in range(300):
        finder = r.choice(list(lanes.ORDER))
        flips.append((f"u{i}", finder))
        listings.append((f"u{i}", r.randrange(1000), r.choice(["", "a", "b", "c"]), r.choice("xyz")))
    out = lanes.throttle(spark.createDataFrame(flips, "uuid string, finder string"), spark.createDataFrame(listings, "uuid string, seq long, seller string, fk string"), None, Lanes())
    told: dict = {}
    kept = set()
    by = dict(flips)
    for u, _, seller, fk in sorted(listings, key=lambda x: (lanes.ORDER[by[x[0]]][1], x[1], x[0])):
        if not seller or told.get((seller, fk), 0) < 3:
            told[seller, fk] = told.get((seller, fk), 0) + 1
            kept.add(u)
    assert {x.uuid for x in out.collect()} == kept


def test_key_stats_edges(spark):
    rows = [("one", "k1", 10.0, 1e6, "s")] + [(f"m{i}", "k2", 10.0 + i, 1e6 + i, "s") for i in range(9)] + [(f"a{i}", "k3", 10.0, 1e6, "") for i in range(5)]
    sales = spark.createDataFrame(rows, "sale_id string, fk string, price double, sold_at double, seller string")
    out = {r.fk: r for r in index.key_stats(sales, 1e6 + 3600, Pricing(max_age_days=10)).collect()}
    assert set(out) == {"k3"} and out["k3"].samples == 5 and out["k3"].target == 10.0 and not out["k3"].manipulated and out["k3"].volatility == 0
    assert index.key_stats(sales.limit(0), 0, Pricing()).count() == 0


def test_greedy_plans(spark):
    plans = spark.createDataFrame([("a", 10.0, 5.0), ("b", 4.0, 4.0), ("c", 3.0, 3.0)], "tag string, cost double, score double")
    assert filters.greedy_plans(plans, [("x", 8.0, 2), ("y", 12.0, 1)], 3) == [("x", "b"), ("y", "a"), ("x", "c")]


def test_item_bytes(spark):
    name = lambda s: struct.pack(">H", len(s)) + s.encode()
    tree = b"\x0a" + name("") + b"\x08" + name("id") + name("SWORD") + b"\x03" + name("n") + struct.pack(">i", 7) + b"\x09" + name("l") + b"\x02" + struct.pack(">i", 2) + struct.pack(">hh", 1, 2) + b"\x00"
    rows = [(base64.b64encode(gzip.compress(tree)).decode(),), (base64.b64encode(tree).decode(),), (base64.b64encode(b"junk").decode(),), (None,)]
    out = [r.j for r in spark.createDataFrame(rows, "b string").select(item_bytes.decode(F.unbase64("b")).alias("j")).collect()]
    assert [json.loads(x) if x else None for x in out] == [{"id": "SWORD", "n": 7, "l": [1, 2]}] * 2 + [None, None]


def test_readers(spark, tmp_path):
    page = lambda n, rows: (tmp_path / "pages").mkdir(exist_ok=True) or (tmp_path / f"pages/{n}.json").write_text(json.dumps({"page": n, "auctions": rows}))
    row = lambda u, bid=5.0, b=True, x="aa": {"uuid": u, "auctioneer": "s", "item_name": "n", "start": 1, "starting_bid": bid, "bin": b, "item_bytes": x}
    page(0, [row("a"), row("b", b=False)])
    page(1, [row("a", 9.0), row("c", x="")])
    assert [(r.uuid, r.starting_bid) for r in readers.listings(spark, str(tmp_path / "pages")).collect()] == [("a", 5.0)]
    spark.createDataFrame([("1", 5.0, 10.0, '{"id": "X", "count": 2}'), ("2", 5.0, 10.0, "{broken"), ("3", 5.0, 1.0, '{"id": "Y"}')], "auction_id string, price double, sold_at double, attrs string").write.parquet(str(tmp_path / "sold"))
    assert [(r.auction_id, r.attrs["count"]) for r in readers.sold(spark, str(tmp_path / "sold"), 5).collect()] == [("1", 2)]
    (tmp_path / "fills.json").write_text('{"ts": 1, "source": "a", "gross": 2}\nnot json\n{"ts": 3, "source": "b"}\n')
    assert [r.source for r in readers.fills(spark, str(tmp_path / "fills.json")).collect()] == ["b", "a"]


def _stream(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
    return spark.readStream.schema(schema).json(str(tmp_path / name))


def _drain(df, spark, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    listed = _stream(spark, tmp_path, "listed", [("a", t(0)), ("b", t(1)), ("z", t(500))], "id string, start timestamp")
    sold = _stream(spark, tmp_path, "sold", [("a", t(5)), ("z2", t(500))], "id string, sold timestamp")
    fates = {r.id: r.fate for r in _drain(flows.sold_or_censored(listed, sold), spark, tmp_path, "fates")}
    assert fates == {"a": "sold", "b": "censored"}
    rows = _stream(spark, tmp_path, "vals", [("k", t(0), 1.0), ("k", t(0.2), 3.0), ("k", t(9), 5.0), ("k", t(99), 5.0)], "key string, ts timestamp, value double")
    counts = _drain(flows.rolling_counts(rows, "key", "ts", "1 hour", None), spark, tmp_path, "counts")
    assert sorted((r.n, r.mean) for r in counts) == [(1, 5.0), (2, 2.0)]
    assert len(_drain(flows.first_seen(rows, "key", "ts"), spark, tmp_path, "firsts")) == 1
    assert sorted(r.n for r in _drain(flows.sessions(rows, "key", "ts", "30 minutes"), spark, tmp_path, "sessions")) == [1, 2]
    events = _stream(spark, tmp_path, "events", [("p", 1.0, "place", 5.0), ("p", 2.0, "confirm", 0.0), ("p", 3.0, "fill", 4.0), ("q", 1.0, "sell", 1.0), ("r", 1.0, "place", 2.0), ("r", 2.0, "cancel", 0.0)], "product string, ts double, event string, units double")
    assert {(r["product"], r.status, r.units) for r in _drain(flows.positions(events), spark, tmp_path, "positions", "update")} == {("p", "filled", 4.0), ("q", "none", 0.0), ("r", "none", 0.0)}
    seen = []
    flows.each_batch(listed, lambda df, n: seen.append(df.count()), str(tmp_path / "ck-each"), once=True).awaitTermination(60)
    assert seen == [3]
