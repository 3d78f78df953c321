"""Rules as data and the coverage gate on literal rows: absent and null fields, torn times, plans, gates, retention."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import coverage

OBSERVED = "account_id string, object_type string, record_id string, at timestamp, properties map<string,string>, coverage array<string>"
RULES = [("r1", "Deal", "stage", ["won", "late"], "owner", 60), ("r2", "Deal", "stage", ["won"], "note", 120), ("none", "Deal", "stage", [], "owner", 0)]
RULE = "rule_id string, object_type string, when_field string, when_values array<string>, required_field string, deadline_minutes long"
PLAN = "object_type string, field string, until timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def now(minutes):
    return F.lit(at(minutes)).cast("timestamp")


def run(spark, rows, plans=(), status="healthy", phase="changes", when=300):
    gate = spark.createDataFrame([("a", status, phase)], "account_id string, status string, phase string")
    got = coverage.clocks(spark.createDataFrame(rows, OBSERVED), spark.createDataFrame(RULES, RULE), spark.createDataFrame(list(plans), PLAN), gate, now(when))
    return {(r.record_id, r.rule_id): (r.since, r.state) for r in got.collect()}


def test_clocks(spark):
    o = lambda i, m, **p: ("a", "Deal", i, at(m), p or None, None)
    rows = [o("1", 0, stage="won", owner=" ", note="n"), o("1", 10, stage="won", owner="", note="n"), o("1", 10, stage="won", owner="", note="n")]
    rows += [o("2", 0, stage="won", owner="", note=""), o("2", 30, stage="won", owner="o", note=""), o("2", 40, stage="late", owner="", note="")]
    rows += [o("3", 0, stage="won", owner="", note="n"), o("3", 50, owner="o"), o("3", 60)]  # absent fields move no clock
    rows += [o("4", 0, stage="won", owner="", note="n"), o("4", 20, stage="won", owner="", note="n"), o("4", 20, stage="lost", owner="", note="n")]  # a torn time
    rows += [o("5", 290, stage="won", owner="", note="n"), ("b", "Deal", "6", at(0), {"stage": "won", "owner": "", "note": "n"}, None)]
    want = {("1", "r1"): (at(0), "due"), ("2", "r1"): (at(40), "due"), ("3", "r1"): (at(0), "due"), ("4", "r1"): (at(0), "due"), ("5", "r1"): (at(290), "waiting"), ("6", "r1"): (at(0), "gated")}
    assert run(spark, rows) == want
    assert {v[1] for k, v in run(spark, rows, status="stale").items()} == {"gated", "waiting"} == {v[1] for v in run(spark, rows, phase="baseline").values()}
    planned = run(spark, rows, plans=[("Deal", "owner", at(1000)), ("Deal", "owner", at(900)), ("Contact", "owner", at(1000))])
    assert planned["1", "r1"][1] == "planned" and run(spark, rows, plans=[("Deal", "owner", at(300))]) == want
    unknown = coverage.unevaluable(spark.createDataFrame(rows, OBSERVED).where("record_id IN ('1', '3')"), spark.createDataFrame(RULES, RULE)).collect()
    assert {(r.record_id, r.rule_id, r.missing) for r in unknown} == {("3", k, "stage") for k in ("r1", "r2", "none")}
    assert run(spark, []) == {}


def test_coverage(spark):
    checks = [("a", at(0), "degraded", "changes", None), ("a", at(290), "healthy", "changes", None), ("b", at(280), "healthy", "changes", None), ("c", at(295), "healthy", "baseline", 9000), ("d", at(299), "healthy", "changes", None), ("e", at(299), "degraded", "baseline", None)]
    seen = [("d", "Deal", "1", at(0), None, ["links"]), ("d", "Deal", "1", at(5), None, []), ("d", "Contact", "1", at(7), None, ["links"]), ("a", "Deal", "2", at(0), None, ["x"]), ("a", "Deal", "2", at(1), None, None)]
    got = coverage.coverage(spark.createDataFrame(checks, "account_id string, at timestamp, status string, phase string, stale_after_seconds long"), spark.createDataFrame(seen, OBSERVED), now(300)).collect()
    assert {r.account_id: (r.status, r.gaps, r.records) for r in got} == {"a": ("healthy", 0, 1), "b": ("stale", 0, 0), "c": ("baseline", 0, 0), "d": ("degraded", 1, 2), "e": ("degraded", 0, 0)}


def test_retained(spark):
    rows = [("a", "Deal", str(i), at(-1440 * i), None, None) for i in range(10)] + [("b", "Deal", "x", at(-10**6), None, None), (None, "Deal", "y", at(0), None, None)]
    policy = spark.createDataFrame([("a", 6, 4)], "account_id string, retention_days long, most long")
    got = coverage.retained(spark.createDataFrame(rows, OBSERVED), policy, now(0)).collect()
    assert sorted((r.account_id or "", r.record_id) for r in got) == [("", "y"), *(("a", str(i)) for i in range(4)), ("b", "x")]
