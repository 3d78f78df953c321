"""Structured Streaming forms of the detectors: deduplicated changes, bulk clears in a trailing window, keyed high-water state, expectation timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.incidents import LEAST_RECORDS, LEAST_SHARE, WINDOW_SECONDS

LATENESS = "10 minutes"


def once(changes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Repeated deliveries (same delivery id) inside the lateness dropped. Needs columns delivery_id, at."""
    return changes.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["delivery_id"])


class TrailingClears(StatefulProcessor):
    """State of a field: the records that lost it at each waiting time, each counted record's end, and the records that end at each time."""

    def __init__(self, seconds: int, least: int):
        self.length, self.least = seconds * 1_000_000 + 1, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "records array<string>")
        self.end_of = handle.getMapState("end_of", "record_id string", "at long")
        self.ends = handle.getMapState("ends", "at long", "records array<string>")
        self.counted = handle.getValueState("counted", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.assign(us=part["at"].astype("datetime64[us]").astype("int64"))
            for us, own in part.groupby("us"):
                held = self.waiting.getValue((us,))[0] if self.waiting.containsKey((us,)) else []
                self.waiting.updateValue((us,), (sorted(set(held) | set(own["record_id"].dropna())),))
                self.handle.registerTimer(us // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        n = self.counted.get()[0] if self.counted.exists() else 0
        ends = sorted(k[0] for k in self.ends.keys())
        out = []
        for us in sorted(k[0] for k in self.waiting.keys() if k[0] < upto):
            while ends and ends[0] <= us:
                over = ends.pop(0)
                for r in self.ends.getValue((over,))[0]:
                    if self.end_of.getValue((r,))[0] == over:  # else it was cleared again since
                        self.end_of.removeKey((r,))
                        n -= 1
                self.ends.removeKey((over,))
            records = self.waiting.getValue((us,))[0]
            self.waiting.removeKey((us,))
            for r in records:
                n += not self.end_of.containsKey((r,))
                self.end_of.updateValue((r,), (us + self.length,))
            if records:
                self.ends.updateValue((us + self.length,), (records,))
                ends.append(us + self.length)
            if records and n >= self.least:
                out.append((key[0], pd.Timestamp(us, unit="us"), n))
        self.counted.update((n,))
        yield pd.DataFrame(out, columns=["field", "at", "records"])

    def close(self) -> None:
        pass


def bulk_clears(changes: DataFrame, population: DataFrame, lateness: str = LATENESS, seconds: int = WINDOW_SECONDS, least: int = LEAST_RECORDS, share: float = LEAST_SHARE) -> DataFrame:
    """(field, at, records, share) of a stream of changes, exactly as ``tidemark.operators.incidents.bulk_clears``: the distinct records that lost a field's value in the window that ends at each time.

    A field's rows wait until the watermark has passed them and are then taken in order of time; its state is bounded by the records cleared in a window and the lateness. population: (field, records), no stream."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    gone = changes.where(blank("after") & ~blank("before")).select("field", "record_id", "at").withWatermark("at", lateness)
    found = gone.groupBy("field").transformWithStateInPandas(TrailingClears(seconds, least), "field string, at timestamp, records long", "append", "EventTime")
    rows = found.join(population.select("field", F.col("records").alias("population")), "field")
    return rows.withColumn("share", F.round(F.col("records") / F.col("population"), 6)).where(F.col("records") / F.col("population") >= share).select("field", "at", "records", "share")


def activity(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events and users per hour and kind."""
    return events.withWatermark("at", lateness).groupBy(F.window("at", "1 hour"), "kind").agg(F.count("*").alias("events")).select(F.col("window.start").alias("hour"), "kind", "events")


def regressions(observations: DataFrame, stages: tuple[str, ...] = ("lead", "mql", "sql", "opportunity", "closed_won")) -> DataFrame:
    """Observations whose stage ranks below the record's greatest so far; older than the last seen are dropped. State: (last time in us, greatest rank)."""
    rank = {s: i + 1 for i, s in enumerate(stages)}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, high = state.get if state.exists else (-1, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "value"]).itertuples():
            at = r.at.value // 1000
            if at < last:
                continue
            last, now = at, rank.get(r.value, 0)
            if now and now < high:
                out.append((key[0], r.at, r.value, high))
            high = max(high, now) if now else 0
        state.update((last, high))
        yield pd.DataFrame(out, columns=["record_id", "at", "value", "high"])

    return observations.groupBy("record_id").applyInPandasWithState(fold, "record_id string, at timestamp, value string, high int", "last long, high int", "append", GroupStateTimeout.NoTimeout)


def expectations(states: DataFrame, values: tuple[str, ...], deadline_minutes: int, lateness: str = LATENESS) -> DataFrame:
    """(record_id, since) once a record's expectation (states: record_id, at, condition, required) has been unmet for the deadline. The timer starts at the first unmet state, runs in event time and is dropped when a state meets it; a state older than the last seen is dropped."""
    deadline = deadline_minutes * 60_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, since = state.get if state.exists else (-1, -1)
        if state.hasTimedOut:
            state.update((last, -2))  # told once, until a state meets it
            yield pd.DataFrame({"record_id": [key[0]], "since": [pd.Timestamp(since, unit="ms")]})
            return
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            at = r.at.value // 1_000_000
            if at < last:
                continue
            last = at
            if r.condition in values and not (r.required or "").strip():
                since = at if since == -1 else since
            else:
                since = -1
        state.update((last, since))
        if since >= 0:
            state.setTimeoutTimestamp(max(since + deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"record_id": [], "since": []})

    keyed = states.withWatermark("at", lateness).groupBy("record_id")
    return keyed.applyInPandasWithState(fold, "record_id string, since timestamp", "last long, since long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream over what is there now, into a memory table of a name (tests and small replays)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
