"""Incident state as streams: each incident's members, passes and timeline, and silences by event-time timers.

Rows wait in keyed state until the watermark has passed their time; then a timer takes them in the order of their times. So shuffled, repeated and late rows (up to
the lateness) give what ``tidemark.operators.incident_state`` rebuilds in batch. State lives in RocksDB, by key: an incident's members are entries of a map,
not one value, and what has been taken is deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.incident_state import fingerprinted
from tidemark.operators.incidents import LEAST_RECORDS

LATENESS = "10 minutes"
HISTORY = "fingerprint string, at timestamp, version long, records long, members long, event string"
SILENCES = "account_id string, last_at timestamp, records long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _power(x: float) -> float:
    return math.floor(math.log2(x)) if x > 0 else -math.inf


class Incident(StatefulProcessor):
    """State of a fingerprint: the waiting rows of each time, its members, and (version, members, resolved)."""

    def __init__(self, least: int = LEAST_RECORDS):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "records array<string>, resolved boolean, detected boolean")
        self.members = handle.getMapState("members", "record_id string", "first_at long")
        self.now = handle.getValueState("now", "version long, members long, resolved boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.assign(us=part["at"].astype("datetime64[us]").astype("int64"))
            for us, own in part.groupby("us"):
                held = self.waiting.getValue((us,)) if self.waiting.containsKey((us,)) else ([], False, False)
                records = set(held[0]) | set(own["record_id"].dropna())
                resolved = own["resolved"].astype(bool)
                self.waiting.updateValue((us,), (sorted(records), held[1] or bool(resolved.any()), held[2] or bool((~resolved).any())))
                self.handle.registerTimer(us // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        version, members, was_resolved = self.now.get() if self.now.exists() else (0, 0, False)
        out = []
        for us in sorted(k[0] for k in self.waiting.keys() if k[0] < upto):
            records, resolved, detected = self.waiting.getValue((us,))
            self.waiting.removeKey((us,))
            if detected:
                had = members
                for r in records:
                    if not self.members.containsKey((r,)):
                        self.members.updateValue((r,), (us,))
                        members += 1
                n = len(records)
                grew = n > had and _power(n / self.least) > _power(max(self.least, had) / self.least)
                event = "detected" if not version else "scope_expanded" if grew else "reopened" if was_resolved else None
                version += 1
                was_resolved = False
                out.append((key[0], pd.Timestamp(us, unit="us"), version, n, members, event))
            was_resolved = was_resolved or resolved
        self.now.update((version, members, was_resolved))
        yield pd.DataFrame(out, columns=["fingerprint", "at", "version", "records", "members", "event"])

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """State of an account: the records active at each recent time."""

    def __init__(self, minutes: int, least: int):
        self.micros, self.least = minutes * 60_000_000, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "at long", "records array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.assign(us=part["at"].astype("datetime64[us]").astype("int64"))
            for us, own in part.groupby("us"):
                held = self.active.getValue((us,))[0] if self.active.containsKey((us,)) else []
                self.active.updateValue((us,), (sorted(set(held) | set(own["record_id"].dropna())),))
                self.handle.registerTimer((us + self.micros) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """All that came up to the silence's end is here: was nothing after the time that set the timer?"""
        over = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.micros
        times = sorted(k[0] for k in self.active.keys())
        out = []
        for us in times:
            if us // 1000 == (over - 1) // 1000 and not any(us < x <= us + self.micros for x in times):
                records = {r for x in times if us - self.micros < x <= us for r in self.active.getValue((x,))[0]}
                if len(records) >= self.least:
                    out.append((key[0], pd.Timestamp(us, unit="us"), len(records)))
        for us in times:
            if us <= over - 2 * self.micros:
                self.active.removeKey((us,))
        yield pd.DataFrame(out, columns=["account_id", "last_at", "records"])

    def close(self) -> None:
        pass


def history(detections: DataFrame, resolutions: DataFrame, lateness: str = LATENESS, least: int = LEAST_RECORDS) -> DataFrame:
    """Streams of detections and resolutions, as in batch. One watermark covers both, so the lateness must cover how far one lags behind the other."""
    rows = fingerprinted(detections).select("fingerprint", "record_id", "at", F.lit(False).alias("resolved"))
    ends = resolutions.select("fingerprint", F.lit(None).cast("string").alias("record_id"), "at", F.lit(True).alias("resolved"))
    keyed = rows.unionByName(ends).withWatermark("at", lateness).groupBy("fingerprint")
    return keyed.transformWithStateInPandas(Incident(least), HISTORY, "append", "EventTime")


def silences(activity: DataFrame, minutes: int, lateness: str = LATENESS, least: int = 1) -> DataFrame:
    """A stream of activity (account_id, record_id, at), as in batch; a silence is told once the watermark has passed it."""
    keyed = activity.withWatermark("at", lateness).groupBy("account_id")
    return keyed.transformWithStateInPandas(Silence(minutes, least), SILENCES, "append", "EventTime")
