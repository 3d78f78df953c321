"""Deliveries in order, proposals and event folds by literal rows."""

import json

from pyspark.sql import functions as F

from tidemark.operators import intake


def test_deliveries_follow_the_checkpoint(spark):
    rows = [("c", 1, "r1", None, None, False, 0), ("c", 2, "r2", "r1", None, False, 60), ("c", 3, "r2", "r1", None, False, 70), ("c", 4, "r9", "r5", None, False, 80), ("c", 5, "r9", "r5", "lost", False, 90), ("c", 6, "r10", "r9", None, False, 100), ("d", 1, "r1", None, None, False, 0), ("d", 2, "r2", "r1", None, False, 73 * 3600)]
    df = spark.createDataFrame(rows, "channel string, seq long, replay_id string, previous_id string, gap_reason string, gaps boolean, received long")
    got = {(r.channel, r.seq): (r.status, r.needs_reconciliation) for r in intake.deliveries(df).collect()}
    assert [got["c", i] for i in range(1, 7)] == [("accepted", False), ("accepted", False), ("duplicate", False), ("conflict", False), ("accepted", True), ("accepted", True)]
    assert got["d", 2] == ("accepted", True)  # beyond the bus's retention


def test_proposals(spark):
    base = {"schemaVersion": 1, "source": "x", "mode": "preview", "workspaceId": "w", "sourceInstanceId": "i", "guards": {"maxRecords": 100, "allowCreate": False}}
    row = lambda i, status=None, **f: {"rowId": i, "externalKey": None, "sourceStatus": status, "proposedFields": f}
    files = [("good", base | {"records": [row("1", email="a@x.com"), row("2", "Needs Review", email="b@x.com")]}), ("twice", base | {"records": [row("1"), row("1")]}), ("creates", base | {"guards": {"maxRecords": 100, "allowCreate": True}, "records": [row("1")]}), ("odd", base | {"records": [row("1", salary="1")]}), ("none", base | {"records": []})]
    df = spark.createDataFrame([(n, json.dumps(f)) for n, f in files] + [("broken", "{")], "path string, json string")
    got = intake.proposals(df).collect()
    assert {r.path: r.fault for r in got} == {"good": None, "twice": "repeated_row", "creates": "not_a_preview", "odd": "fields", "none": "rows", "broken": "not_json"}
    good = {r.row_id: (r.excluded, r.fields) for r in got if r.path == "good"}
    assert good == {"1": (False, {"email": "a@x.com"}), "2": (True, {"email": "b@x.com"})} and len({r.contact_id for r in got if r.path == "good"}) == 2


def test_native_reversals_break_at_ties_and_plans(spark):
    def returns(values, planned=()):
        rows = [("r", "f", t, v, t in planned) for t, vs in enumerate(values) for v in vs]
        return [r.returns for r in intake.native_reversals(spark.createDataFrame(rows, "record_id string, field string, at long, value string, planned boolean"), 2).collect()]

    assert returns(["a", "b", "a", "b"]) == [2] and returns(["a", "a", "b", "b", "a"]) == []
    assert returns(["a", "b", "ab", "a", "b"]) == [] and returns(["a", "b", "a", "b"], planned=(2,)) == []


def test_attempts_hold_an_event(spark):
    q = spark.createDataFrame([("1", "a", None, False, 0), ("2", "a", None, False, 2), ("3", "a", "2024-01-01", False, 2)], "id string, account_id string, processed_at string, held boolean, attempts int").withColumns({"received_at": F.lit("2024-01-01").cast("timestamp_ntz"), "next_attempt_at": F.lit(None).cast("timestamp_ntz")})
    got = {r.id: (r.attempts, r.held) for r in intake.after_failures(q, q.select("id"), F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert got == {"1": (1, False), "2": (3, True), "3": (2, False)}


def test_tolerant_reading_and_contact_round_trip(spark, tmp_path):
    from tidemark.sources import csv_files as C

    assert C.parse_tolerant('a,b\nx"y"z,"p,""q"" r"\n\n1,2') == [["a", "b"], ["xyz", 'p,"q" r'], [""], ["1", "2"]]
    for bad in ('a,b\n"x', "a,b\n1\n"):
        try:
            C.parse_tolerant(bad)
        except C.CsvError:
            continue
        raise AssertionError(bad)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text('record_id,given_name,surname,email,issues,recordstatus,target_stage,import_skip_reason,import_skipped_at\n1,Ada,Smith,A+b@X.com,"a; B|a",merged,sql,,\n1,Bo,Li,,,,,,\n3,,,c@x.com,,active,,later,2026-09-27T22:00:00.000Z\n4,,,d@x.com,,merged,,later,\n')
    docs = C.read_documents(spark, str(tmp_path / "in"), tolerant=True)
    head = docs.first().headers
    rows = C.typed_contacts(docs, head, C.suggest_mapping(head))
    got = {r.row_id: r for r in rows.collect()}
    assert (got[1].full_name, got[1].normalized_email, got[1].record_status, got[1].expected_lifecycle_stage, got[1].quality_flags) == ("Ada Smith", "a+b@x.com", "merged", "sql", ["a", "b", "a"])
    assert [got[i].row_fault for i in (1, 2, 3, 4)] == [None, "repeated_id:1", None, "skip_data"] and got[3].excluded and got[3].full_name == "3"
    assert [(r.n_rows, len(r.first)) for r in C.preview(docs, 2).collect()] == [(4, 2)]
    C.write_lines(C.export_contacts(rows.where("row_id = 1")).coalesce(1), str(tmp_path / "out"), C.export_header(), crlf=True)
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    again = C.parse_tolerant(part.read_bytes().decode())
    assert len(again[0]) == 22 and dict(zip(*again))["email"] == "A+b@X.com" and dict(zip(*again))["quality_flags"] == "a|b|a"
    for i in range(4):
        C.save_revision(spark.range(1), str(tmp_path / "rev"), i, keep=2)
    assert sorted(p.name for p in (tmp_path / "rev").iterdir()) == ["revision=00000002", "revision=00000003"]
