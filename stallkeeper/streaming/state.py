"""Flows with state of their own: benched prices, relists, held-back flips, order positions, snapshots between dumps.

The keyed flows need the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Their time is that of the
events: state ends and held rows go when the watermark passes, not when a clock does, so a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000


def _ms(time: pd.Timestamp) -> int:
    return int(time.value // 1_000_000)


def _in_order(batches: Iterator[pd.DataFrame], *more: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", *more], kind="stable")


def _flow(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


# Prices that moved too far


@dataclass(frozen=True)
class Guard:
    window_min: int = 30
    trigger_pct: float = 10.0
    bench_min: int = 15


def moved(live: float, anchor: float | None) -> float:
    """Percent; without an anchor nothing has moved."""
    return abs(live - anchor) / anchor * 100 if anchor and anchor > 0 else 0.0


class _Bench(StatefulProcessor):
    def __init__(self, guard: Guard) -> None:
        self.guard = guard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long, ask double, bid double")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues):
        seen = [tuple(r) for r in self.recent.get()]
        until = self.until.get()[0] if self.until.exists() else 0
        out = []
        for row in _in_order(rows).itertuples():
            now = _ms(row.ts)
            seen = [s for s in seen if s[0] >= now - self.guard.window_min * MINUTE]
            before = [s for s in seen if s[0] < now]
            worst = max((moved(live, median(s[i] for s in before)) for i, live in ((1, row.ask), (2, row.bid))), default=0.0) if before else 0.0
            tripped = now >= until and worst > self.guard.trigger_pct
            if tripped:
                until = now + self.guard.bench_min * MINUTE
            out.append((key[0], row.ts, worst, tripped, now < until))
            seen.append((now, row.ask, row.bid))
        self.recent.put(seen)
        self.until.update((until,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(until, seen[-1][0] + self.guard.window_min * MINUTE) + 1)
        yield pd.DataFrame(out, columns=["product", "ts", "moved_pct", "tripped", "benched"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        self.until.clear()
        yield pd.DataFrame(columns=["product", "ts", "moved_pct", "tripped", "benched"])

    def close(self) -> None:
        pass


def benched(snapshots: DataFrame, guard: Guard = Guard(), late: str = "1 minute") -> DataFrame:
    """snapshots (product, ts, ask, bid): how far a price has moved from the median of its own side in the window before,
    whether that trips the guard, and whether the product is benched. A benched product isn't looked at until its bench
    is over, so it isn't benched for longer. State is a window's snapshots."""
    return _flow(snapshots.select("product", "ts", "ask", "bid"), ["product"], _Bench(guard), "product string, ts timestamp, moved_pct double, tripped boolean, benched boolean", late)


# Relists


class _Relists(StatefulProcessor):
    def __init__(self, limit: int, idle_ms: int) -> None:
        self.limit, self.idle = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getMapState("told", "uuid string", "at long")

    def handleInputRows(self, key, rows, timerValues):
        told = {k[0] for k in self.told.keys()}
        out, last = [], 0
        for row in _in_order(rows, "uuid").itertuples():
            free = not key[0] or row.uuid in told or len(told) < self.limit
            if free and key[0]:
                told.add(row.uuid)
                self.told.updateValue((row.uuid,), (_ms(row.ts),))
                last = max(last, _ms(row.ts))
            out.append((*key, row.uuid, row.ts, free))
        if last:
            for timer in self.handle.listTimers():
                last = max(last, timer - self.idle)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame(out, columns=["seller", "fk", "uuid", "ts", "passes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.told.clear()
        yield pd.DataFrame(columns=["seller", "fk", "uuid", "ts", "passes"])

    def close(self) -> None:
        pass


def relists(flips: DataFrame, limit: int = 3, idle: str = "7 days", late: str = "1 minute") -> DataFrame:
    """flips (seller, fk, uuid, ts) with passes: whether the seller has had fewer than limit other listings of the key told
    of. Listings told of once pass again; unnamed sellers always. A pair's state ends when none was told of for idle."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    own = flips.select(F.coalesce("seller", F.lit("")).alias("seller"), "fk", "uuid", "ts")
    return _flow(own, ["seller", "fk"], _Relists(limit, ms), "seller string, fk string, uuid string, ts timestamp, passes boolean", late)


# Flips held back until they can be bought


class _Release(StatefulProcessor):
    def __init__(self, hold_ms: int) -> None:
        self.hold = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "release long, price double")

    def _out(self, key, rows):
        return pd.DataFrame([(key[0], price, pd.Timestamp(release, unit="ms")) for release, price in rows], columns=["uuid", "price", "release"])

    def handleInputRows(self, key, rows, timerValues):
        now, waiting = [], []
        for row in _in_order(rows).itertuples():
            release = _ms(row.start) + self.hold
            (now if release <= _ms(row.ts) else waiting).append((release, row.price))
        if waiting:
            self.held.appendList(waiting)
            for release, _ in waiting:
                self.handle.registerTimer(release)
        yield self._out(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.held.get()]
        rest = [r for r in held if r[0] > due]
        self.held.put(rest) if rest else self.held.clear()
        yield self._out(key, [r for r in held if r[0] <= due])

    def close(self) -> None:
        pass


def released(flips: DataFrame, grace_ms: int = 20_000, lead_ms: int = 1_500, late: str = "1 second") -> DataFrame:
    """flips (uuid, price, start, ts) once they can nearly be bought: grace after their start less lead. Those seen later
    than that come at once, the others when the watermark has passed their release. Held flips are in the state, so a
    restart loses none."""
    return _flow(flips.select("uuid", "price", "start", "ts"), ["uuid"], _Release(grace_ms - lead_ms), "uuid string, price double, release timestamp", late)


# Orders


@dataclass(frozen=True)
class OrderRules:
    tax: float = 0.0125
    phantom_min: float = 10  # an order that nobody confirms for so long never was
    strikes: int = 3
    retry_min: float = 2
    rebuy_min: float = 30
    settle_min: float = 180  # an offer that rests for so long counts as sold


POSITION = "units double, price double, placed long, confirmed boolean, filled double, offered double, sold double, ask double, issued long"
LEDGER = ["owner", "product", "ts", "event", "units", "net", "strikes", "barred_until"]


class _Orders(StatefulProcessor):
    def __init__(self, rules: OrderRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", POSITION)
        self.strikes = handle.getValueState("strikes", "n long")
        self.barred = handle.getValueState("barred", "until long")

    def _get(self, state, none):
        return state.get()[0] if state.exists() else none

    def _row(self, key, at, event, units=0.0, net=0.0):
        return (*key, pd.Timestamp(at, unit="ms"), event, float(units), float(net), self._get(self.strikes, 0), self._get(self.barred, 0))

    def _timers(self, p) -> None:
        """At most one: what happens to the position if nothing else does."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if p and not p["confirmed"]:
            self.handle.registerTimer(int(p["placed"] + self.rules.phantom_min * MINUTE))
        elif p and p["offered"] > 0:
            self.handle.registerTimer(int(p["issued"] + self.rules.settle_min * MINUTE))

    def _net(self, p, units):
        return units * (p["ask"] * (1 - self.rules.tax) - p["price"]) if p["ask"] else 0.0

    def _close(self, key, at, event, p):
        """A position that ends bars the product from being bought again for a while."""
        self.barred.update((int(at + self.rules.rebuy_min * MINUTE),))
        return self._row(key, at, event, p["sold"])

    def _load(self):
        names = [c.split()[0] for c in POSITION.split(", ")]
        return dict(zip(names, self.position.get())) if self.position.exists() else None

    def _save(self, p) -> None:
        self.position.update(tuple(p.values())) if p else self.position.clear()
        self._timers(p)

    def _step(self, key, at, row, p):
        """The position after an event, and the ledger rows it makes."""
        event, units, coins = row.event, row.units, row.coins
        if event == "place":
            if p or at < self._get(self.barred, 0):
                return p, [self._row(key, at, "refused", units)]
            return {"units": units, "price": coins / units, "placed": at, "confirmed": False, "filled": 0.0, "offered": 0.0, "sold": 0.0, "ask": 0.0, "issued": 0}, [self._row(key, at, "placed", units)]
        if event == "buy_placed":
            adopted = not p
            if adopted and not (units > 0 and coins > 0):
                return p, []
            p = p or {"units": units, "price": coins / units, "placed": at, "confirmed": True, "filled": 0.0, "offered": 0.0, "sold": 0.0, "ask": 0.0, "issued": 0}
            self.strikes.clear()
            return p | {"confirmed": True, "units": units}, [self._row(key, at, "adopted" if adopted else "confirmed", units)]
        if not p:
            return p, []
        if event == "buy_filled":
            return p | {"filled": p["filled"] + units}, [self._row(key, at, "filled", units)]
        if event == "offer":
            return p | {"offered": units, "ask": coins / units if units else 0.0, "issued": at}, [self._row(key, at, "offered", units)]
        if event == "sell_filled":
            made = self._row(key, at, "sold", units, self._net(p, units))
            p = p | {"sold": p["sold"] + units, "offered": max(p["offered"] - units, 0.0), "ask": 0.0, "issued": at}
            if p["sold"] >= p["units"] - 1:
                return None, [made, self._close(key, at, "closed", p)]
            return p, [made]
        if event == "sell_cancelled":
            return p | {"offered": 0.0, "ask": 0.0}, [self._row(key, at, "sell_cancelled")]
        if event == "not_competitive" and not p["confirmed"]:
            return None, [self._row(key, at, "dropped", p["units"])]
        return p, []

    def _expire(self, key, at, p):
        if not p["confirmed"]:
            n = self._get(self.strikes, 0) + 1
            self.strikes.update((n,))
            self.barred.update((int(at + (self.rules.retry_min if n < self.rules.strikes else self.rules.rebuy_min) * MINUTE),))
            return None, [self._row(key, at, "phantom", p["units"])]
        made = self._row(key, at, "settled", p["offered"], self._net(p, p["offered"]))
        p = p | {"sold": p["sold"] + p["offered"], "offered": 0.0, "ask": 0.0}
        if p["sold"] >= p["units"] - 1:
            return None, [made, self._close(key, at, "closed", p)]
        return p, [made]

    def _due(self, p):
        if p and not p["confirmed"]:
            return p["placed"] + self.rules.phantom_min * MINUTE
        return p["issued"] + self.rules.settle_min * MINUTE if p and p["offered"] > 0 else float("inf")

    def handleInputRows(self, key, rows, timerValues):
        p, out = self._load(), []
        for row in _in_order(rows, "seq").itertuples():
            at = _ms(row.ts)
            if self._due(p) <= at:  # its time came before this event, though the watermark hasn't told yet
                p, made = self._expire(key, int(self._due(p)), p)
                out += made
            p, made = self._step(key, at, row, p)
            out += made
        self._save(p)
        yield pd.DataFrame(out, columns=LEDGER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        p, out = self._load(), []
        if self._due(p) <= expiredTimerInfo.getExpiryTimeInMs():
            p, out = self._expire(key, int(self._due(p)), p)
            self._save(p)
        yield pd.DataFrame(out, columns=LEDGER)

    def close(self) -> None:
        pass


def orders(events: DataFrame, rules: OrderRules = OrderRules(), late: str = "10 seconds") -> DataFrame:
    """What becomes of each owner's position in a product, from events (owner, product, ts, seq, event, units, coins; coins
    of all units): place, buy_placed, buy_filled, offer, sell_filled, sell_cancelled, not_competitive.

    An order that nobody confirms for phantom_min is a phantom: a strike, and the product is barred for retry_min, or for
    rebuy_min from the last strike on. A confirmation clears the strikes, tells the true units, and adopts an order that
    wasn't known. An offer that rests for settle_min counts as sold. A position that ends bars the product for rebuy_min;
    orders for a barred or held product are refused. Rows are ledger entries with net coins after tax."""
    own = events.select("owner", "product", "ts", "seq", "event", "units", "coins")
    return _flow(own, ["owner", "product"], _Orders(rules), "owner string, product string, ts timestamp, event string, units double, net double, strikes long, barred_until long", late)


# Snapshots


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions that were written in full."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(p.getName()[1:]) for p in found if done(p))


def publish(df: DataFrame, folder: str, version: int, keep: int = 3) -> None:
    """Writes a version of a snapshot table; readers see it when it is there in full. The last keep versions stay."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/v{version}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in _versions(spark, folder)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{old}"), True)


def latest(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, DataFrame] | None:
    """The newest version (below before) and its table, None where there is none."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    return (found[-1], spark.read.parquet(f"{folder}/v{found[-1]}")) if found else None


def dumps(stream: DataFrame, folder: str, tell: Callable[[DataFrame, int], None], checkpoint: str, primed_rows: int = 20_000, once: bool = False):
    """Each micro-batch is a dump of all that is live (uuid, ...). tell gets the rows that the dump before didn't have; not
    while there is none before or it has primed_rows at most. What is kept between dumps is pruned to what is live. A
    batch that is run again after a failure looks at the same dump before."""

    def one(dump: DataFrame, batch: int) -> None:
        dump = dump.dropDuplicates(["uuid"])
        before = latest(dump.sparkSession, folder, batch)
        if before and before[1].count() > primed_rows:
            tell(dump.join(before[1].select("uuid"), "uuid", "left_anti"), batch)
        publish(dump.select("uuid"), folder, batch)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def priced_by_latest(stream: DataFrame, index_folder: str, price: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, once: bool = False):
    """Calls price(batch, index, version) with the newest index version for each micro-batch; batches before the first
    version are left out."""

    def one(batch: DataFrame, _: int) -> None:
        found = latest(batch.sparkSession, index_folder)
        if found:
            price(batch, found[1], found[0])

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()
