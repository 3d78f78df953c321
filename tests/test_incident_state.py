"""Incident state: streams over shuffled, late and repeated rows against the batch rebuild, and the batch against a fold by hand."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from test_streams import parts
from tidemark.operators import incident_state as batch
from tidemark.streaming import incident_state as live
from tidemark.streaming.incidents import run_to_end

DETECTIONS = "kind string, object_type string, field string, record_id string, at timestamp"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, live.ROCKSDB)
    yield spark
    spark.conf.set(key, old)


def found(rng, n=150, minutes=2000):
    rows = []
    for _ in range(n):
        when = rng.randrange(minutes // 50) * 50
        kind = rng.choice(["clear", "coverage"])
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            rows.append((kind, "Contact", rng.choice(["email", None]), rng.choice([None, *map(str, range(60))]), at(when)))
    ends = [(f, at(rng.randrange(minutes))) for f in ("clear:Contact:email", "coverage:Contact", "never:seen") for _ in range(6)] + [("clear:Contact:email", at(50))]
    return rows, ends


def by_hand(rows, ends, least):
    """The fold, one incident after the other."""
    out = []
    marks = {":".join(x for x in r[:3] if x is not None) for r in rows}
    for mark in marks:
        own = [(r[4], 0, r[3]) for r in rows if ":".join(x for x in r[:3] if x is not None) == mark] + [(t, 1, None) for f, t in ends if f == mark]
        members, version, resolved = set(), 0, False
        for when, end in sorted({(t, e) for t, e, _ in own}):
            if end:
                resolved = True
                continue
            records = {r for t, e, r in own if (t, e) == (when, 0) and r is not None}
            n, had = len(records), len(members)
            grew = n > had and math.floor(math.log2(n / least)) > math.floor(math.log2(max(least, had) / least))
            members |= records
            version += 1
            out.append((mark, when, version, n, len(members), "detected" if version == 1 else "scope_expanded" if grew else "reopened" if resolved else None))
            resolved = False
    return sorted(out, key=repr)


def test_history_in_batch(spark):
    rng = random.Random(4)
    rows, ends = found(rng)
    d, e = spark.createDataFrame(rows, DETECTIONS), spark.createDataFrame(ends, "fingerprint string, at timestamp")
    got = sorted((tuple(r) for r in batch.history(d, e, least=3).collect()), key=repr)
    assert got == by_hand(rows, ends, 3) and {r[5] for r in got} == {"detected", "scope_expanded", "reopened", None}
    again = sorted((tuple(r) for r in batch.history(d.union(d), e.union(e), least=3).collect()), key=repr)
    assert again == got
    first = {}
    for r in sorted(rows, key=lambda r: r[4]):
        if r[3] is not None:
            first.setdefault((":".join(x for x in r[:3] if x is not None), r[3]), r[4])
    assert {(r.fingerprint, r.record_id): r.first_at for r in batch.members(d).collect()} == first
    assert batch.history(d.limit(0), e, least=3).count() == 0 == batch.members(d.limit(0)).count()


def test_history_as_a_stream(rocks, tmp_path):
    rng = random.Random(5)
    rows, ends = found(rng, n=60, minutes=1000)
    sent = rows + rng.sample(rows, 30)  # repeated, and up to six hours out of order
    sent.sort(key=lambda r: r[4] + dt.timedelta(minutes=rng.randrange(360)))
    last = ("mark", "x", None, None, at(50_000))
    d = parts(rocks, [*sent, last, last], DETECTIONS, str(tmp_path / "d"), 4)
    e = parts(rocks, sorted(ends, key=lambda r: r[1]), "fingerprint string, at timestamp", str(tmp_path / "e"), 2)
    got = run_to_end(live.history(d, e, "3000 minutes", least=3), "history").collect()
    want = batch.history(rocks.createDataFrame(rows, DETECTIONS), rocks.createDataFrame(ends, "fingerprint string, at timestamp"), least=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((tuple(r) for r in want), key=repr)


@pytest.mark.parametrize("least", [1, 4])
def test_silences(rocks, tmp_path, least):
    rng = random.Random(7 + least)
    rows, when = [], 0
    for _ in range(120):
        when += rng.choice([1, 3, 9, 15, 16, 40])
        rows += [(rng.choice("ab"), str(rng.randrange(9)), at(when)) for _ in range(rng.choice([1, 3]))]
    schema = "account_id string, record_id string, at timestamp"
    want = set()
    for a in "ab":
        times = sorted({r[2] for r in rows if r[0] == a})
        for i, t in enumerate(times):
            if i + 1 == len(times) or times[i + 1] - t > dt.timedelta(minutes=15):
                n = len({r[1] for r in rows if r[0] == a and t - dt.timedelta(minutes=15) < r[2] <= t})
                if n >= least:
                    want.add((a, t, n))
    got = batch.silences(rocks.createDataFrame(rows, schema), 15, F.lit("2024-03-01").cast("timestamp"), least).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 3
    sent = sorted(rows + rows[::7], key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(60)))
    stream = parts(rocks, [*sent, ("z", "0", at(90_000))], schema, str(tmp_path / "s"), 4)
    told = run_to_end(live.silences(stream, 15, "300 minutes", least), f"silences{least}").collect()
    assert sorted(tuple(r) for r in told) == sorted(want)


def test_related_records_are_bounded_before_they_meet(spark):
    people = [("Contact", f"p{i:03d}", at(i), {"company_id": f"c{i % 7}", "contact_ids": f'["p{i + 1:03d}", "p{i + 1:03d}", "none"]', "company_ids": "[broken" if i % 2 else None}) for i in range(80)]
    records = spark.createDataFrame([*people, *(("Company", f"c{i}", at(0), None) for i in range(5))], "object_type string, record_id string, at timestamp, properties map<string,string>")
    held = spark.createDataFrame([("all", f"p{i:03d}") for i in range(80)] * 2 + [("one", "p005"), ("gone", "x"), ("none", None)], "fingerprint string, record_id string")
    got = batch.related(held, records)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    named = list(dict.fromkeys(x for i in range(79, 29, -1) for x in (("Company", f"c{i % 7}"), ("Contact", f"p{i + 1:03d}"), ("Contact", "none"))))[: batch.RELATED]
    there = {(r[0], r[1]) for r in people} | {("Company", f"c{i}") for i in range(5)}
    rows = got.collect()
    assert sorted((r.place, r.object_type, r.record_id) for r in rows if r.fingerprint == "all") == [(n + 1, *x) for n, x in enumerate(named) if x in there]
    assert {(r.object_type, r.record_id) for r in rows if r.fingerprint == "one"} == {("Contact", "p006")}
    assert {r.fingerprint for r in rows} == {"all", "one"}
