"""The delivery ledger and the notice outbox: repeats after the watermark, restarts, and stops between two writes."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_streams import at, parts
from tidemark.operators import incidents, intake
from tidemark.streaming import incidents as live
from tidemark.streaming.incident_state import ROCKSDB
from tidemark.streaming.ledger import DIGEST, DeliveryLedger, NoticeOutbox, stream_into

SCHEMA = "channel string, seq long, replay_id string, previous_id string, gap_reason string, gaps boolean, received long, body string"


def log(rng):
    """Channels with old repeats, replay ids that come again with another body, conflicts and stated gaps."""
    rows = []
    for c in "ab":
        last, past, seq = None, [], 0
        for i in range(40):
            seq += 1
            kind = rng.choice(["next"] * 5 + ["again", "other", "lost", "gap"])
            if kind == "again" and past:
                rows.append((c, seq, *past[rng.randrange(len(past))], 100 * i, "x"))
                continue
            if kind == "other" and past:
                rows.append((c, seq, *past[-1], 100 * i, f"new body {i}"))
                if past[-1][1] == last or past[-1][2] is not None:
                    last = past[-1][0]
                continue
            row = (f"r{i}", last if kind in ("next", "again", "other") else f"q{i}", "lost" if kind == "gap" else None, i == 20)
            rows.append((c, seq, *row, 100 * i + (300_000 if i > 30 else 0), "x"))
            if kind != "lost":
                last = f"r{i}"
                past.append(row)
    return rows


def told(df):
    return sorted((r.channel, r.seq, r.status, r.needs_reconciliation) for r in df.collect())


def test_ledger_equals_batch_through_restarts(spark, tmp_path):
    rows = log(random.Random(3))
    rows.sort(key=lambda r: (r[1], r[0]))
    want = told(intake.deliveries(spark.createDataFrame(rows, SCHEMA)))
    assert {w[2] for w in want} == {"accepted", "duplicate", "conflict"}
    ledger = DeliveryLedger(spark, str(tmp_path / "ledger"))
    stream = parts(spark, rows, SCHEMA, str(tmp_path / "s"), 5)
    calls = collections.Counter()

    def dies_once(df, batch):
        calls[batch] += 1
        ledger.process(df, batch)
        if batch == 2 and calls[batch] == 1:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        stream_into(stream, dies_once, str(tmp_path / "c"))
    stream_into(stream, dies_once, str(tmp_path / "c"))
    assert calls[2] == 2 and max(calls) == 4
    assert told(ledger.parts.read()) == want
    stream_into(stream, dies_once, str(tmp_path / "c"))  # nothing new
    assert told(ledger.parts.read()) == want
    old = next(r for r, w in zip(sorted(rows), want, strict=True) if w[2] == "accepted")
    ledger.process(spark.createDataFrame([(old[0], 1000, *old[2:])], SCHEMA), 50)  # a repeat long after
    assert told(ledger.parts.read().where("batch = 50"))[0][2] == "duplicate"
    state = {r.channel: r for r in ledger.checkpoints().collect()}
    assert all(state[c].needs_reconciliation == [w for w in want if w[0] == c][-1][3] for c in "ab")


NOTICE = "key string, title string, summary string, at timestamp"


def notices(spark, keys, minute=0):
    return spark.createDataFrame([(k, f"t {k}", "s", at(minute)) for k in keys], NOTICE)


def states(box):
    return {r.key: r.state for r in box.states().collect()}


def test_outbox_tells_at_most_once(spark, tmp_path):
    sent, answer = [], ["delivered"]

    def send(digest):
        sent.append([d["key"] for d in digest])
        if answer[0] == "stop":
            raise RuntimeError("killed while sending")
        return answer[0], 120 if answer[0] == "rate_limited" else None

    box = NoticeOutbox(spark, str(tmp_path / "box"), send)
    box.process(notices(spark, ["a", "b", "b"]), 0)
    box.process(notices(spark, ["a", "b", "b"]), 0)  # the batch again
    assert sent == [["a", "b"]] and states(box) == {"a": "delivered", "b": "delivered"}
    answer[0] = "stop"
    with pytest.raises(RuntimeError):
        box.process(notices(spark, ["c", "a"], 1), 1)
    assert states(box)["c"] == "unknown"
    answer[0] = "delivered"
    box.process(notices(spark, ["c", "a"], 1), 1)
    box.process(notices(spark, ["d"], 2), 2)
    assert sent == [["a", "b"], ["c"], ["d"]] and states(box) == {"a": "delivered", "b": "delivered", "c": "unknown", "d": "delivered"}
    answer[0] = "rate_limited"
    box.process(notices(spark, ["e"], 3), 3)
    answer[0] = "delivered"
    box.process(notices(spark, ["f"], 4), 4)  # a minute later: too early
    assert states(box)["e"] == states(box)["f"] == "pending" and len(sent) == 4
    box.process(notices(spark, ["g"], 5), 5)
    assert sent[-1] == ["e", "f", "g"] and set(states(box).values()) == {"delivered", "unknown"}
    answer[0] = "failed"
    many = [f"n{i:02d}" for i in range(DIGEST + 3)]
    box.process(notices(spark, many, 6), 6)
    assert sent[-1] == many[:DIGEST] and collections.Counter(states(box).values())["pending"] == 3


def test_outbox_stopped_before_the_claim(spark, tmp_path):
    sent = []
    box = NoticeOutbox(spark, str(tmp_path / "box"), lambda digest: (sent.append(len(digest)), ("delivered", None))[1])
    deliver = box.deliver
    box.deliver = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        box.process(notices(spark, ["a"]), 0)
    box.deliver = deliver
    box.process(notices(spark, ["a"]), 0)
    assert sent == [1] and states(box) == {"a": "delivered"}


def test_trailing_clears_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(25)}", rng.choice("fg"), rng.choice(["x", ""]), rng.choice(["", " ", None, "y"]), at(0) + dt.timedelta(seconds=rng.randrange(12_000))) for _ in range(260)]
    schema = "record_id string, field string, before string, after string, at timestamp"
    population = spark.createDataFrame([("f", 25), ("g", 40)], "field string, records long")
    want = incidents.bulk_clears(spark.createDataFrame(rows, schema), population, least=4, share=0.2).collect()
    sent = sorted(rows + rows[::9], key=lambda r: r[4] + dt.timedelta(seconds=rng.randrange(3000)))
    stream = parts(spark, [*sent, ("z", "h", "x", "", at(90_000))], schema, str(tmp_path / "s"), 4)
    got = live.run_to_end(live.bulk_clears(stream, F.broadcast(population), "100 minutes", least=4, share=0.2), "trailing").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10
