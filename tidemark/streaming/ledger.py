"""Streams that write: a ledger of deliveries and an outbox of notices, by foreachBatch.

Tables are parts by batch id in a folder that all executors share. A batch reads the parts before its own and writes its own part over, so
a batch that is run again after a failure writes the same rows once more and nothing twice, however far it had come.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.window import Window

from tidemark.operators.intake import content_digest, fold_deliveries

DELIVERIES = "channel string, seq long, digest string, replay_id string, status string, needs_reconciliation boolean, held string, held_received long"
#: Events of one digest at most, seconds until the next attempt after a rate limit that names none.
DIGEST, RETRY_SECONDS = 20, 60
NOTICES = "key string, title string, summary string, at timestamp"
CLAIMS = "key string"
OUTCOMES = "state string, not_before timestamp"


class Parts:
    """A table of parts by batch id."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.schema = spark, path, StructType.fromDDL(ddl)

    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ids(self) -> list[int]:
        """Batches whose part is whole: Spark marks those."""
        p, fs = self._folder()
        if not fs.exists(p):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for x in fs.listStatus(p) if (n := x.getPath().getName()).startswith("batch=") and fs.exists(done(x.getPath(), "_SUCCESS")))

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their batch, of the batches before one."""
        paths = [f"{self.path}/batch={i}" for i in self.ids() if before is None or i < before]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields]).add("batch", IntegerType())).option("basePath", self.path).parquet(*paths)


class DeliveryLedger:
    """Deliveries of change-event channels, each told accepted, duplicate or conflict once: by the digests of all that was accepted before, however long ago."""

    def __init__(self, spark: SparkSession, root: str):
        self.parts = Parts(spark, f"{root}/deliveries", DELIVERIES)

    def checkpoints(self, before: int | None = None) -> DataFrame:
        """(channel, replay_id, received, needs_reconciliation) as the last delivery of each channel left them."""
        last = F.max_by(F.struct("held", "held_received", "needs_reconciliation"), F.struct("batch", "seq")).alias("c")
        return self.parts.read(before).groupBy("channel").agg(last).select("channel", F.col("c.held").alias("replay_id"), F.col("c.held_received").alias("received"), "c.needs_reconciliation")

    def process(self, rows: DataFrame, batch: int) -> None:
        """foreachBatch function for deliveries (channel, seq, replay_id, previous_id, gap_reason, gaps, received, body if there is one). A channel's new rows meet in one task, with its checkpoint; no earlier ones do."""
        rows = rows.withColumn("digest", content_digest(rows)).drop("body")
        old = self.parts.read(batch).where("status = 'accepted'").select("channel", "digest").distinct().withColumn("known", F.lit(True))
        held = self.checkpoints(batch).select("channel", F.col("replay_id").alias("held"), F.col("received").alias("held_received"), F.col("needs_reconciliation").alias("gap"))
        rows = rows.join(old, ["channel", "digest"], "left").withColumn("known", F.coalesce("known", F.lit(False))).join(held, "channel", "left")

        names = self.parts.schema.names

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            none = lambda x: None if pd.isna(x) else x
            received = none(first["held_received"])
            told = fold_deliveries(pdf, none(first["held"]), None if received is None else int(received), bool(none(first["gap"])))
            out = pd.DataFrame(list(told), columns=["seq", "digest", "status", "needs_reconciliation", "held", "held_received"])
            out.insert(0, "channel", first["channel"])
            replay = pdf.set_index("seq")["replay_id"]
            out["replay_id"] = [replay.loc[[s]].iloc[0] for s in out["seq"]]
            return out[names]

        self.parts.write(batch, rows.groupBy("channel").applyInPandas(fold, DELIVERIES))


class NoticeOutbox:
    """Notices told at most once. A batch first writes which notices it takes, then sends them as one digest, then writes what came of it.

    Notices that were taken and of which nothing is known stay unknown and are never sent again: a receiver has no key to tell repeats by."""

    def __init__(self, spark: SparkSession, root: str, send: Callable[[list[dict]], tuple[str, int | None]]):
        """send: gets at most DIGEST notices, gives (delivered, failed, unknown or rate_limited, seconds to wait)."""
        self.spark, self.send = spark, send
        self.notices, self.claims, self.outcomes = Parts(spark, f"{root}/notices", NOTICES), Parts(spark, f"{root}/claims", CLAIMS), Parts(spark, f"{root}/outcomes", OUTCOMES)

    def states(self) -> DataFrame:
        """(key, state) of every notice: pending, delivered, failed or unknown."""
        outcomes = self.outcomes.read().select("batch", "state")
        claims = self.claims.read().join(outcomes, "batch", "left").withColumn("state", F.coalesce("state", F.lit("unknown"))).where("state <> 'rate_limited'")
        return self.notices.read().select("key").join(claims.select("key", "state"), "key", "left").select("key", F.coalesce("state", F.lit("pending")).alias("state"))

    def pending(self) -> DataFrame:
        """Notices to send, oldest first, one digest of them."""
        open_ = self.states().where("state = 'pending'").select("key")
        return self.notices.read().join(open_, "key", "left_semi").orderBy("at", "key").limit(DIGEST)

    def process(self, rows: DataFrame, batch: int) -> None:
        """foreachBatch function for notices (key, title, summary, at); of one key the first is kept. At most one digest a batch."""
        if batch not in self.notices.ids():
            first = Window.partitionBy("key").orderBy("at", "title", "summary")
            new = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
            self.notices.write(batch, new.join(self.notices.read(batch).select("key"), "key", "left_anti"))
        now = self.notices.read().agg(F.max("at")).head()[0]
        self.deliver(batch, now)

    def deliver(self, batch: int, now) -> None:
        """One attempt; none where this batch has made one before, or where the last rate limit has not passed."""
        if batch in self.claims.ids():
            return
        wait = self.outcomes.read().agg(F.max("not_before")).head()[0]
        if now is None or wait is not None and now < wait:
            return
        digest = [r.asDict() for r in self.pending().select(*self.notices.schema.names).collect()]  # DIGEST rows at most
        if not digest:
            return
        self.claims.write(batch, self.spark.createDataFrame([(r["key"],) for r in digest], CLAIMS).coalesce(1))
        state, seconds = self.send(digest)
        not_before = now + pd.Timedelta(seconds=seconds or RETRY_SECONDS).to_pytimedelta() if state == "rate_limited" else None
        self.outcomes.write(batch, self.spark.createDataFrame([(state, not_before)], OUTCOMES).coalesce(1))


def stream_into(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what is there now into a foreachBatch function."""
    q = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
