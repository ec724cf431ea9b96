"""Structured Streaming flows over listing and sale feeds. Times are event-time timestamps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, key: str, time: str, within: str = "4 days") -> DataFrame:
    """First row of each key; state goes with the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def sold_or_censored(listings: DataFrame, sales: DataFrame, censor: str = "4 days") -> DataFrame:
    """Listings (id, start) left-joined to sales (id, sold) within censor of the start: a row without a sale comes out when
    the watermark has passed, as censored."""
    left = listings.withWatermark("start", "1 hour").alias("l")
    right = sales.withColumnRenamed("id", "sale_id").withWatermark("sold", "1 hour").alias("s")
    on = (F.col("id") == F.col("sale_id")) & (F.col("sold") >= F.col("start")) & (F.col("sold") <= F.col("start") + F.expr(f"INTERVAL {censor}"))
    joined = left.join(right, on, "leftOuter")
    return joined.select("id", "start", "sold", F.when(F.col("sold").isNull(), "censored").otherwise("sold").alias("fate"))


def rolling_counts(stream: DataFrame, key: str, time: str, window: str = "24 hours", slide: str | None = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and mean of value per key and tumbling or sliding window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window, slide) if slide else F.window(time, window), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, key: str, time: str, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, detect: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Runs detect on every micro-batch (a dump): it joins the batch to the last snapshot tables and replaces them."""
    writer = stream.writeStream.foreachBatch(detect).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


#: What an event does to a position; anything else leaves it as it is.
STEPS = {("none", "place"): "placed", ("placed", "confirm"): "open", ("placed", "fill"): "filled", ("open", "fill"): "filled", ("open", "cancel"): "none", ("placed", "cancel"): "none", ("filled", "offer"): "offered", ("offered", "sell"): "sold", ("sold", "place"): "placed"}


def positions(events: DataFrame, idle_minutes: int = 30) -> DataFrame:
    """events (product, ts, event, units) to the state of each product's position after each batch; a placed order that
    nothing confirms for idle_minutes is dropped as a phantom."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, units = state.get if state.exists else ("none", 0.0)
        if state.hasTimedOut:
            state.remove()
            if status == "placed":
                yield pd.DataFrame({"product": [key[0]], "status": ["phantom"], "units": [0.0]})
            return
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            after = STEPS.get((status, row.event), status)
            units = row.units if after != status and row.event in ("place", "fill") else 0.0 if after in ("none", "sold") else units
            status = after
        state.update((status, float(units)))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"product": [key[0]], "status": [status], "units": [float(units)]})

    return events.groupBy("product").applyInPandasWithState(step, "product string, status string, units double", "status string, units double", "update", GroupStateTimeout.ProcessingTimeTimeout)
