"""ST2: a daily budget as a stateful stream: a reservation passes while the day's counter is under the budget.

The state of a UTC day is its counter and the numbers of accepted and denied reservations and of events. A timer at the next midnight
closes the day: it gives one row of totals and forgets the state. Rows of a closed day are late and don't count. The
batch twin is streams.budget.

Costs: 0.006 a minute begun; without a duration the seconds of the upload's bytes; with neither the reservation stays.
A reservation or refund without a time is dropped. State is kept by RocksDB, which configured() sets.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Price of a reservation, of a minute, and bytes that stand for a second.
RESERVATION, MINUTE, BYTES = 0.03, 0.006, 16_000
DECISIONS = "day string, ts timestamp, kind string, accepted boolean, cost double, spent double, closed boolean, n_accepted long, n_denied long, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> None:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def cost(seconds: float | None, size: float | None) -> float:
    """What a transcription costs; the reservation if neither its seconds nor its bytes are known."""
    if seconds is None or math.isnan(seconds) or seconds <= 0:
        if size is None or math.isnan(size) or size <= 0:
            return RESERVATION
        seconds = size / BYTES
    return MINUTE * math.ceil(seconds / 60)


class Day:
    """The counter of a day. Every change is rounded to six places, so that sums of prices compare as written."""

    def __init__(self, spent: float = 0.0, accepted: int = 0, denied: int = 0, seq: int = 0):
        self.spent, self.accepted, self.denied, self.seq = spent, accepted, denied, seq

    def event(self, kind: str, seconds: float | None, size: float | None, budget: float) -> tuple[bool, float]:
        """Whether it passes, and what it adds to the counter."""
        change = 0.0
        passes = kind != "reserve" or self.spent < budget
        if kind == "reserve":
            change = RESERVATION if passes else 0.0
            self.accepted += passes
            self.denied += not passes
        elif kind == "reconcile":
            change = round(cost(seconds, size) - RESERVATION, 6)
        elif kind == "refund":
            change = -RESERVATION
        self.spent = round(self.spent + change, 6)
        self.seq += 1
        return passes, change


class Budget(StatefulProcessor):
    def __init__(self, budget: float):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("day", "spent double, accepted long, denied long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = Day(*self.state.get()) if self.state.exists() else None
        if day is None:
            day = Day()
            midnight = datetime.datetime.fromisoformat(key[0]).replace(tzinfo=datetime.UTC) + datetime.timedelta(days=1)
            self.handle.registerTimer(int(midnight.timestamp() * 1000))
        # Of one batch the events count in the order of their times; what arrives later counts later.
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for e in events.itertuples(index=False):
            passes, change = day.event(e.kind, e.duration_seconds, e.upload_bytes, self.budget)
            out.append((key[0], e.ts, e.kind, passes, change, day.spent, False, day.accepted, day.denied, day.seq))
        self.state.update((day.spent, day.accepted, day.denied, day.seq))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            day = Day(*self.state.get())
            self.state.clear()
            yield pd.DataFrame([(key[0], None, "closed", None, None, day.spent, True, day.accepted, day.denied, day.seq)], columns=[c.split()[0] for c in DECISIONS.split(", ")])

    def close(self) -> None:
        pass


def decisions(events: DataFrame, budget: float, late: str = "10 minutes") -> DataFrame:
    """A stream of events (event_id, ts, kind: reserve, reconcile or refund, duration_seconds, upload_bytes) -> one row for each event,
    with the counter after it, and one row for each day that is over."""
    rows = events.filter("ts IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "kind", F.col("duration_seconds").cast("double").alias("duration_seconds"), F.col("upload_bytes").cast("double").alias("upload_bytes"))
    days = rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withWatermark("ts", late)
    return days.groupBy("day").transformWithStateInPandas(Budget(budget), DECISIONS, "Append", "EventTime")


def run(events: DataFrame, budget: float, path: str, late: str = "10 minutes"):
    """Appends the decisions on all events there are to `path`/decisions; a later run goes on from `path`/checkpoint."""
    configured(events.sparkSession)
    return decisions(events, budget, late).writeStream.format("parquet").option("path", f"{path}/decisions").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
