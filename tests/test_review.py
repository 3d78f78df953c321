"""Identity, matching, incident and review cases by literal rows and brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import contacts, identity, incidents, matching, monitor, review

PERSON = "record_key string, object_type string, first_name string, last_name string, email string, company string, phone string, secondary_phone string, website string, job_title string, created_at string"


def people(spark, rows):
    blank = dict.fromkeys((f.split()[0] for f in PERSON.split(", ")), "")
    return spark.createDataFrame([tuple((blank | {"created_at": None, "object_type": "contact"} | r)[f.split()[0]] for f in PERSON.split(", ")) for r in rows], PERSON)


def test_secondary_phones_match_and_are_no_conflict(spark):
    df = people(spark, [{"record_key": "a", "first_name": "Ada", "last_name": "Smith", "company": "Acme", "phone": "4125550100", "secondary_phone": "4125550101"}, {"record_key": "b", "first_name": "Ada", "last_name": "Smith", "company": "Acme", "phone": "4125550199", "secondary_phone": "4125550101"}])
    (pair,) = identity.scored_pairs(identity.normalized(df)).collect()
    assert pair.score == 100 and [e.key for e in pair.evidence] == ["phone", "name", "company"]


def test_survivor_order_and_recovery(spark):
    df = people(
        spark,
        [
            {"record_key": "contact:2", "first_name": "Ada", "last_name": "Smith", "email": "ada@x.com"},
            {"record_key": "lead:1", "object_type": "lead", "first_name": "Ada", "last_name": "Smith", "email": "ada@x.com", "company": "Late", "phone": "4125550100", "website": "x.com", "job_title": "CEO"},
            {"record_key": "k:1", "first_name": "Bo", "last_name": "Li", "email": "bo@x.com", "created_at": "2024-01-02"},
            {"record_key": "k:2", "first_name": "Bo", "last_name": "Li", "email": "bo@x.com", "created_at": "2023-01-02"},
        ],
    )
    members = identity.clusters(identity.scored_pairs(identity.normalized(df)))
    got = {r.survivor: r for r in identity.survivors(members, df).collect()}
    assert set(got) == {"contact:2", "k:2"}  # a contact before a richer lead; the older of equal ones
    assert (got["contact:2"].company, got["contact:2"].job_title) == ("Late", "CEO")
    assert {r.band for r in members.where("record_key LIKE '%:%' AND cluster_id <> ''").collect()} == {"review", "high_confidence"}


def brute_clusters(pairs):
    """Cliques as the rules say, over all pairs at once."""
    score, clusters = {frozenset((a, b)): s for a, b, s in pairs}, []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if any(a in c and b in c for c in clusters):
            continue
        homes = [c for c in clusters if a in c or b in c]
        homes.sort(key=lambda c: (a not in c, clusters.index(c)))
        for c in homes:
            new = b if a in c else a
            if s >= 75 and all(score.get(frozenset((k, new)), 0) >= 75 for k in c):
                c.add(new)
                break
        else:
            if s < 75 and any(a in c for c in clusters) and any(b in c for c in clusters):
                continue
            clusters.append({a, b})
    return sorted("|".join(sorted(c)) for c in clusters)


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    names = [f"r{i:02}" for i in range(40)]
    pairs = [(a, b, rng.choice((60, 66, 69, 75, 80, 96))) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.06]
    df = spark.createDataFrame(pairs, "a string, b string, score int").withColumn("band", F.when(F.col("score") >= 75, "review").otherwise("possible"))
    got = identity.clusters(df).groupBy("cluster_key").agg(F.array_join(F.sort_array(F.collect_list("record_key")), "|").alias("m")).collect()
    assert sorted(r.m for r in got) == brute_clusters(pairs)


def test_matching_of_states_aliases_and_self(spark):
    assert [r.s for r in spark.createDataFrame([("California",), ("C.A.",), ("ｃａ",), ("Quebec  City",), ("12",)], "x string").select(matching.state(F.col("x")).alias("s")).collect()] == ["ca", "ca", "ca", "quebec city", None]
    rows = [("1", "Ada Smith", "ada@x.com", ["al@y.com"], "4125550100", "California"), ("2", "Ada Smith", "", [], "4125550100", "CA"), ("3", "Zed Poe", "al@y.com", [], "", "")]
    df = spark.createDataFrame(rows, "contact_id string, full_name string, email string, additional_emails array<string>, phone string, state string").withColumn("company", F.lit(""))
    got = {(r.input_id, r.record_id): r.evidence for r in matching.match_people(df, df, existing_id="contact_id", exclude_self=True).collect()}
    assert got[("1", "2")] == "name|unique_phone|state"  # its own phone is not counted
    assert got[("3", "1")] == "exact_email|name_conflict" and ("1", "1") not in got
    assert ("1", "2") not in {(r.input_id, r.record_id) for r in matching.match_people(df, df, existing_id="contact_id", exclude_self=True, fields=("email",)).collect()}


def test_trailing_window_and_ambiguity(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rng = random.Random(3)
    rows = list({(f"r{rng.randrange(30)}", "f", t(rng.randrange(240))) for _ in range(200)})
    df = spark.createDataFrame([(r, f, "x", "", a) for r, f, a in rows], "record_id string, field string, before string, after string, at timestamp")
    got = {(r.at, r.records) for r in incidents.bulk_clears(df, spark.createDataFrame([("f", 40)], "field string, records long"), least=5, share=0.1).collect()}
    want = {a: len({r for r, _, b in rows if b <= a and a - b <= dt.timedelta(minutes=30)}) for _, _, a in rows}
    assert got == {(a, n) for a, n in want.items() if n >= 5}
    seen = spark.createDataFrame([("r", "f", "a", t(0)), ("r", "f", "b", t(1)), ("r", "f", "c", t(1)), ("r", "f", "a", t(2))], "record_id string, field string, value string, at timestamp")
    assert incidents.changes(seen).count() == 0 and [r.at for r in incidents.ambiguous(seen).collect()] == [t(1)]
    plan = spark.createDataFrame([("f", t(100))], "field string, until timestamp")
    assert incidents.unplanned(df, plan).count() == sum(a >= t(100) for _, _, a in rows)


def test_warehouse_canonical_is_flagged(spark):
    rows = [("1", "A@x.com", "merged", []), ("2", "a@x.com", "active", ["duplicate_identity"]), ("3", "a@x.com", "active", ["duplicate_identity", "missing_owner"])]
    df = spark.createDataFrame(rows, "contact_id string, raw_email string, record_status string, quality_flags array<string>").withColumn("normalized_email", F.lower("raw_email"))
    got = {r.contact_id: (r.canonical_contact_id, r.record_status, r.quality_flags) for r in contacts.warehouse_merge(df).collect()}
    assert got == {"1": (None, "merged", []), "2": (None, "active", []), "3": ("2", "merged", ["duplicate_identity", "missing_owner"])}


def test_monitor_rules(spark):
    rows = [("1", "hubspot", "Contact", {"email": "a@x.com", "company": " Acme"}), ("2", "hubspot", "Company", {"email": ""}), ("3", "salesforce", "Contact", {"company": " Acme", "jobtitle": " "}), ("4", "hubspot", None, {"lifecyclestage": "lead"})]
    df = spark.createDataFrame(rows, "record_id string, provider string, object_type string, props map<string,string>")
    old = spark.createDataFrame([("4", "customer")], "record_id string, high_water string")
    assert {(r.record_id, r.rule): r.after for r in monitor.issues(df, old).collect()} == {("1", "text_whitespace"): {"company": "Acme"}, ("3", "text_whitespace"): {"jobtitle": ""}, ("4", "lifecycle_regression"): {"lifecyclestage": "lead"}}
    assert {r.record_id: r.high_water for r in monitor.high_waters(df, old).collect()} == {"1": None, "2": None, "3": None, "4": "customer"}


def test_report_cells_are_guarded(spark):
    cells = ["=1", " ​=1", "\tx", 'a"b', None, "-5", "ok"]
    got = [r.c for r in spark.createDataFrame([(c,) for c in cells], "x string").select(review.report_cell(F.col("x")).alias("c")).collect()]
    assert got == ['"\'=1"', '"\' ​=1"', '"\'\tx"', '"a""b"', '""', '"\'-5"', '"ok"']
