"""Text functions, contacts, identity, matching, routing, incidents, state, CSV and streaming on literal rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.ranks import ranked
from tidemark.operators import contacts, identity, incidents, matching, routing, state
from tidemark.sources import csv_files
from tidemark.streaming import incidents as live


def values(spark, column, *items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalisers(spark):
    assert values(spark, T.email, " A+b@X.Example ", "signal@mañana.example", "a@b", "a b@x.com", "é@x.com", "a@x.com:80", None) == ["a+b@x.example", "signal@xn--maana-pta.example", None, None, None, None, None]
    assert values(spark, T.email_alias, "a.b+c@gmail.com", "a.b@googlemail.com", "a.b+c@x.com") == ["ab@gmail.com", "ab@gmail.com", "a.b+c@x.com"]
    assert values(spark, T.phone, "(412) 555-0100 ext. 9", "+44 20 7946 0000", "000000000", "123") == ["14125550100", "442079460000", None, None]
    assert values(spark, T.name, "Dr. José  Núñez Jr.", "mr") == ["jose nunez", None]
    assert values(spark, T.company, "Acme, Inc.", "LLC") == ["acme", None]
    assert values(spark, T.domain, "https://www.Acme.com/a?b", "acme.com", "nothing", "http://mañana.example/") == ["acme.com", "acme.com", None, "xn--maana-pta.example"]
    assert values(spark, T.header, "\tE-mail Address ", "Owner") == ["e_mail_address", "owner"]
    assert values(spark, T.fnv1a, "a|b", "") == ["294c7dd6", "811c9dc5"]
    assert values(spark, T.flags, "A b|c;,d") == [["a_b", "c", "d"]]
    assert values(spark, T.formula_guard, "=1", " +1", "x") == ["'=1", "' +1", "x"]
    assert values(spark, lambda x: F.concat_ws("/", *T.split_name(x)), "Ada B Smith", "Ada") == ["Ada B/Smith", "Ada"]


def test_comparisons(spark):
    pairs = [("morgan", "morgen", 0.6), ("a", "a", 1.0), ("a", "ab", 0.6), ("b", "ab", 0.0), ("aaaa", "aa", 0.5)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    assert all(abs(r.d - r.want) < 1e-9 for r in df.withColumn("d", T.dice(F.col("a"), F.col("b"))).collect())
    edits = [("smith", "smiht", True), ("smith", "smit", True), ("smith", "smith", False), ("abcd", "badc", False), ("ab", "ba", True), ("", "a", True)]
    df = spark.createDataFrame(edits, "a string, b string, want boolean")
    assert all(r.d == r.want for r in df.withColumn("d", T.one_edit(F.col("a"), F.col("b"))).collect())
    typos = [("anders@x.com", "andres@x.com", True), ("bob@x.com", "bbo@x.com", False), ("bob@acme.com", "bob@acem.com", True), ("anders+a@x.com", "andres@x.com", False)]
    df = spark.createDataFrame(typos, "a string, b string, want boolean")
    assert all(r.d == r.want for r in df.withColumn("d", T.email_typo(F.col("a"), F.col("b"))).collect())


CONTACT = "contact_id string, raw_email string, company string, region string, segment string, lifecycle_stage string, expected_lifecycle_stage string, owner_id string, record_status string"


def test_contact_repairs(spark):
    rows = [("1", "A@X.COM", "Acme", "Northeast", "ENTERPRISE", "lead", "lead", "o", "active"), ("2", "a@x.com", "Acme", "W", "S", "mql", "opportunity", "", "active"), ("3", "bad", "", "W", "S", "lead", "lead", "o", "active"), ("4", "a+b@x.com", "Acme", "W", "S", "lead", "lead", "o", "active")]
    df = contacts.flagged(spark.createDataFrame(rows, CONTACT))
    flags = {r.contact_id: set(r.quality_flags) for r in df.collect()}
    assert flags == {"1": {"duplicate_identity"}, "2": {"duplicate_identity", "missing_owner", "stage_regression"}, "3": {"invalid_email", "missing_company"}, "4": {"plus_address_present"}}
    merged = {r.contact_id: (r.record_status, r.canonical_contact_id) for r in contacts.repair(df, "merge").collect()}
    assert merged["1"] == ("merged", "2") and merged["2"] == ("active", "2") and merged["4"] == ("active", None)
    assert contacts.repair(df, "reroute").where("owner_id = 'NE-ENT-OVERFLOW'").count() == 1
    assert {r.lifecycle_stage for r in contacts.repair(df, "replay").where("contact_id = '2'").collect()} == {"opportunity"}
    with pytest.raises(ValueError):
        contacts.repair(df, "other")
    report = contacts.audit(df).first()
    assert (report.rows, report.active, report.ready, report.readiness, report.label, report.automatable) == (4, 4, 1, 25, "Blocked", 2)
    out = contacts.exclude(df, spark.createDataFrame([("1",)], "contact_id string"))
    assert "duplicate_identity" not in {f for r in out.collect() for f in r.quality_flags}
    fixed = contacts.correct(df, spark.createDataFrame([("3", "c@x.com", "Acme")], "contact_id string, raw_email string, company string"))
    assert fixed.where("contact_id = '3'").first().quality_flags == []


PERSON = "record_key string, object_type string, first_name string, last_name string, email string, company string, phone string, website string, job_title string"


def test_identity(spark):
    rows = [("a", "contact", "Ada", "Smith", "ada@acme.com", "Acme", "4125550100", "", ""), ("b", "contact", "Ada", "Smith", "ada@acme.com", "Acme Inc", "4125550100", "acme.com", "CEO"), ("c", "contact", "Bob", "Jones", "info@acme.com", "Acme", "", "", ""), ("d", "contact", "Zoe", "Quill", "info@acme.com", "Other", "", "", ""), *((f"p{i}", "contact", "", f"N{i}", f"p{i}@z{i}.com", "", "4125559999", "", "") for i in range(5))]
    people = spark.createDataFrame(rows, PERSON)
    pairs = identity.scored_pairs(identity.normalized(people)).collect()
    assert [(r.a, r.b, r.score, r.band) for r in pairs] == [("a", "b", 100, "high_confidence")]
    members = identity.clusters(identity.scored_pairs(identity.normalized(people)))
    got = members.orderBy("record_key").collect()
    assert [(r.record_key, r.size, r.confidence, r.band) for r in got] == [("a", 2, 100, "high_confidence"), ("b", 2, 100, "high_confidence")]
    assert got[0].cluster_id == "294c7dd6"
    kept = identity.survivors(members, people).first()
    assert (kept.survivor, kept.website, kept.job_title) == ("b", "acme.com", "CEO")
    shared = spark.createDataFrame([(f"k{i:03}", "contact", "", "", "x@y.com", "", "", "", "") for i in range(101)], PERSON)
    assert identity.candidate_pairs(identity.normalized(shared)).count() == 101 * 100 // 2
    board = spark.createDataFrame([(f"k{i:03}", "contact", "", f"n{i}", "", "", "4125550000", "", "") for i in range(500)], PERSON)
    assert identity.candidate_pairs(identity.normalized(board)).count() == 0


def test_matching(spark):
    crm = spark.createDataFrame([("r1", "Ada Smith", "ada@acme.com", "4125550100", "Acme"), ("r2", "Ada Smyth", "x@acme.com", "", "Acme"), ("r3", "Bo Li", "bo@z.com", "", "")], "record_key string, full_name string, email string, phone string, company string")
    new = spark.createDataFrame([("i1", "Ada Smith", "ada@acme.com", "412-555-0100", "Acme"), ("i2", "Nobody Here", "q@q.com", "", "")], "contact_id string, full_name string, email string, phone string, company string")
    got = matching.match_people(new, crm).orderBy("input_id", "rank").collect()
    assert got[0].asDict() == {"input_id": "i1", "record_id": "r1", "score": 100, "rank": 1, "evidence": "exact_email|name|unique_phone|company"}
    assert {r.input_id for r in got} == {"i1"}


def test_a_shared_email_is_cut_by_order(spark, monkeypatch):
    """An email that more records share than an input may look at: the first by id are looked at, as if all had met."""
    people = [(f"r{i:02d}", "Ada Smith", "a@x.com", "Acme", None) for i in range(30)] + [("r99", "Ada Smith", "b@x.com", "Acme", "+1 202 555 0101")]
    crm = spark.createDataFrame(people, "record_key string, full_name string, email string, company string, phone string")
    new = spark.createDataFrame([("i1", "Ada Smith", "a@x.com", "Acme", None), ("i2", "Bo Doe", "b@x.com", "Beta", None)], "contact_id string, full_name string, email string, company string, phone string")
    whole = sorted(map(tuple, matching.match_people(new, crm).collect()))
    monkeypatch.setattr(matching, "MOST", 5)
    assert sorted(map(tuple, matching.match_people(new, crm).collect())) == whole
    assert {r.input_id: r.capped for r in matching.match_warnings(new, crm).collect()} == {"i1": True, "i2": False}
    itself = matching.match_people(crm, crm, "record_key", exclude_self=True).where("input_id = 'r00'").collect()
    assert sorted(r.record_id for r in itself) == ["r01", "r02", "r03"]


def test_routing(spark):
    reps = spark.createDataFrame([("a", "W", "S", True, 2, 1), ("b", "W", "S", True, 4, 1), ("c", "W", "S", False, 9, 0)], "rep_id string, region string, segment string, active boolean, capacity long, assigned long")
    asks = spark.createDataFrame([(i, f"q{i}", "W", "S") for i in range(6)], "seq long, request_id string, region string, segment string")
    got = {r.request_id: r.rep_id for r in routing.assign(asks, reps).collect()}
    assert got == {"q0": "b", "q1": "a", "q2": "b", "q3": "b", "q4": None, "q5": None}
    assert [r.rep_id for r in routing.ranked_reps(reps).orderBy("rank").collect()] == ["b", "a"]


def test_pools_equal_the_fold(spark):
    """Places by rank give what a fold over the requests gives, on pools of uneven reps, with ties, full and absent ones."""
    rng = random.Random(11)
    reps = [(f"p{i:02d}", rng.choice(["E", "W", None]), rng.choice("SG"), rng.random() < 0.8, rng.choice([0, 1, 2, 4, 8]), rng.choice([0, 0, 1, 3])) for i in range(40)]
    asks = [(rng.randrange(60), f"q{i}", rng.choice(["E", "W", None]), rng.choice("SG")) for i in range(150)]
    used, want = {r[0]: r[5] for r in reps}, {}
    for seq, ask, region, segment in sorted(asks, key=lambda q: (q[0], q[1])):
        free = [(used[r[0]] / r[4], r[0]) for r in reps if r[3] and region is not None and r[1] == region and r[2] == segment and used[r[0]] < r[4]]
        want[ask] = min(free)[1] if free else None
        if free:
            used[want[ask]] += 1
    df = spark.createDataFrame(asks, "seq long, request_id string, region string, segment string").repartition(5)
    got = routing.assign(df, spark.createDataFrame(reps, "rep_id string, region string, segment string, active boolean, capacity long, assigned long")).collect()
    assert {r.request_id: r.rep_id for r in got} == want and all((r.status == "routed") == (r.rep_id is not None) for r in got) and len(set(want.values())) > 10
    assert routing.assign(df.limit(0), spark.createDataFrame(reps, "rep_id string, region string, segment string, active boolean, capacity long, assigned long")).count() == 0


def test_ranks_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(30), i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, v long, id long").repartition(7), ["g"], [F.col("v").desc()]).collect()
    for g in ("a", "b", None):
        own = sorted((r["rank"], r.v) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted((v for _, v in own), reverse=True)
    assert len(got) == 500



def test_incidents(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    seen = spark.createDataFrame([("r", "f", v, t(i)) for i, v in enumerate(["a", "b", "a", "b", "a", "b", "a"])] + [("r", "f", "a", t(6))], "record_id string, field string, value string, at timestamp")
    changed = incidents.changes(seen)
    assert changed.count() == 6 and incidents.reversals(changed).first().reversals == 3
    gone = spark.createDataFrame([(f"r{i}", "f", "x", None, t(0)) for i in range(12)], "record_id string, field string, before string, after string, at timestamp")
    people = spark.createDataFrame([("f", 40)], "field string, records long")
    assert incidents.bulk_clears(gone, people).collect()[0].records == 12 and incidents.bulk_clears(gone.limit(5), people).count() == 0
    high = incidents.high_water(spark.createDataFrame([("r", v, t(i)) for i, v in enumerate(["mql", "sql", "lead", "odd", "lead"])], "record_id string, value string, at timestamp"))
    assert [r.regressed for r in high.orderBy("at").collect()] == [False, False, True, False, False]
    old = spark.createDataFrame([("a", "open", 10), ("b", "resolved", 10), ("c", "open", 10)], "key string, status string, records long")
    new = spark.createDataFrame([("a", "open", 15), ("b", "open", 10), ("c", "open", 20), ("d", "open", 10)], "key string, status string, records long")
    assert {r.key: r.why for r in incidents.notices(old, new).collect()} == {"b": "reopened", "c": "grown", "d": "new"}


def test_state(spark):
    old = spark.createDataFrame([("a", "open", 1), ("b", "resolved", 1), ("c", "open", 1)], "key string, status string, occurrences long")
    got = {r.key: (r.status, r.occurrences) for r in state.upsert_findings(old, spark.createDataFrame([("a",), ("b",), ("d",)], "key string")).collect()}
    assert got == {"a": ("open", 1), "b": ("open", 2), "c": ("resolved", 1), "d": ("open", 1)}
    rows = spark.createDataFrame([("a", 1), ("e", 2), ("e", 2)], "key string, x int")
    assert [r.key for r in state.insert_new(old, rows, "key").collect()] == ["e"]


def test_csv(spark, tmp_path):
    assert csv_files.parse_strict('﻿a,"b ""q"""\r\n"x\ny",2\r3,') == [["a", 'b "q"'], ["x\ny", "2"], ["3", ""]]
    for bad in ('a"b', '"a"b', '"a'):
        with pytest.raises(csv_files.CsvError):
            csv_files.parse_strict(bad)
    (tmp_path / "good.csv").write_text('Id,Work Email,Company\n1,"A@X.com ",=Acme\n,,\n2,b@x.com,"B, Co"\n')
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    docs = csv_files.read_documents(spark, str(tmp_path)).cache()
    assert [r.error for r in docs.where("error IS NOT NULL").collect()] == ["1 cells instead of 2 in row 2"]
    head = docs.where("error IS NULL").first().headers
    mapping = csv_files.suggest_mapping(head)
    assert mapping == {"contact_id": "Id", "raw_email": "Work Email", "company": "Company"}
    people = csv_files.typed_contacts(docs, head, mapping).orderBy("contact_id")
    assert [(r.contact_id, r.raw_email, r.region) for r in people.collect()] == [("1", "A@X.com", "Unassigned"), ("2", "b@x.com", "Unassigned")]
    assert [(r.line, r.guarded) for r in csv_files.csv_lines(people, ("contact_id", "company")).collect()] == [("1,'=Acme", 1), ('2,"B, Co"', 0)]
    assert csv_files.cleanup_proposals(docs, 1).select("after").first().after == "a@x.com"
    assert csv_files.suggest_mapping(["email", "email_address"])["raw_email"] if "raw_email" in csv_files.suggest_mapping(["email", "email_address"]) else True


def test_streams_agree_with_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(f"d{i}", f"r{i}", "f", "x", None, t(1)) for i in range(12)] * 2 + [("z", "r0", "g", "x", None, t(300))]
    schema = "delivery_id string, record_id string, field string, before string, after string, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "c"))
    assert live.run_to_end(live.once(stream), "once").count() == 13
    seen = [("r", t(i), v) for i, v in enumerate(["mql", "sql", "lead", "odd", "lead"])]
    spark.createDataFrame(seen, "record_id string, at timestamp, value string").coalesce(1).write.parquet(str(tmp_path / "s"))
    out = live.run_to_end(live.regressions(spark.readStream.schema("record_id string, at timestamp, value string").parquet(str(tmp_path / "s"))), "regress")
    assert [(r.value, r.high) for r in out.collect()] == [("lead", 3)]


def test_component_labels_run_until_nothing_changes(spark):
    order = [f"n{(i * 4) % 9}" for i in range(9)]
    pairs = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a string, b string")
    labels = identity.component_labels(pairs).collect()
    assert len(labels) == 9 and {r.label for r in labels} == {"n0"}
