"""Registered queries of imports under review, monitor rules and incident state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contacts as C
from tidemark.operators import incidents as N
from tidemark.operators import monitor as M
from tidemark.operators import review as R
from tidemark.plans.contact_queries import F_SQL
from tidemark.sources.views import contacts, table

AS_OF = "2024-02-01 00:00:00"


def _k(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"))


def _saved(s, d):
    """Flagged contacts with the fields that a CRM takes."""
    k = F.substring("contact_id", 3, 8).cast("long")
    none = F.lit(None).cast("string")
    phone = F.when(k % 7 == 0, F.repeat(F.lit("5"), 45)).when(k % 3 == 0, "").otherwise(F.concat(F.lit(" 412"), k.cast("string")))
    return C.flagged(contacts(s, d)).withColumns({"first_name": none, "last_name": F.when(k % 5 == 0, " Quill "), "phone": phone, "job_title": none, "website": F.when(k % 2 == 0, "x.com")})


_SAVED = "s AS (SELECT *, CAST(contact_id[3:] AS BIGINT) k FROM f)"
_HUB = "normalized_email IS NOT NULL AND NOT list_has_any(fl, ['duplicate_identity','invalid_email','stage_regression'])"


def _batches(s, d):
    k = F.col("k")
    return _k(s, d).select(F.floor(k / 60).alias("batch"), F.when(k % 180 == 7, k - 1).otherwise(k).cast("string").alias("contact_id"), F.concat(F.lit("M"), F.when(k % 180 == 70, k - 1).otherwise(k).cast("string")).alias("email"))


def _scans(s, d):
    k = F.col("k")
    at = F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - (k % 50 - 3) * 30)
    return _k(s, d).select(k.alias("scan_id"), F.when(k % 9 == 0, "w2").otherwise("w1").alias("workspace_id"), F.when(k % 8 == 0, "salesforce").otherwise("hubspot").alias("connector_id"), (k % 7 != 0).alias("complete"), F.when(k % 5 != 0, True).alias("source_complete"), at.alias("started_at"))


def _creates(s, d):
    k = F.col("k")
    rows = _k(s, d)
    said = lambda every, times: rows.where(k % every == 0).select(k.cast("string").alias("input_id"), F.explode(F.sequence(F.lit(1), F.lit(times))))
    return R.create_reviews(rows.select(k.cast("string").alias("contact_id")), said(5, 2), said(7, 1), rows.where(k % 11 != 0).select(k.cast("string").alias("contact_id")), None)


def _decisions(s, d):
    k = F.col("k")
    rows = _k(s, d).withColumns({"contact_id": k.cast("string"), "native_id": F.concat(F.lit("n"), k.cast("string")), "a": F.when(k % 4 == 0, " ").otherwise("x"), "b": k})
    old = rows.select("contact_id", "native_id", R.source_key("a", "b").alias("row_key"), R.source_key("native_id").alias("target_key"))
    now = rows.where("k % 13 <> 0").withColumn("a", F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("a"))).select("contact_id", R.source_key("a", "b").alias("row_key"))
    targets = rows.where("k % 9 <> 0").select("native_id", F.when(k % 10 == 0, R.source_key("a")).otherwise(R.source_key("native_id")).alias("target_key"))
    return R.valid_decisions(old, now, targets)


def _claims(s, d):
    k = F.col("k")
    rows = _k(s, d).select(k.cast("string").alias("contact_id"), F.concat(F.lit("M"), k.cast("string")).alias("email"))
    text = lambda n: F.concat(F.lit("m"), n.cast("string"))
    targets = _k(s, d).where("k % 3 = 0").select(k.alias("native_id"), F.array(text(k), F.when(k % 2 == 0, text(k + 1)).otherwise("")).alias("emails"))
    decided = _k(s, d).where("k % 30 = 2").select((k + 1).alias("native_id"), k.cast("string").alias("contact_id"))
    return R.claims(rows, targets, decided)


def _people(s, d):
    """Proposed rows and CRM records for them."""
    k = F.col("k")
    c = _k(s, d)
    phone = F.concat(F.lit("412555"), F.lpad((k % 10000).cast("string"), 4, "0"))
    proposed = c.select(k.cast("string").alias("contact_id"), F.concat(F.lit("m"), (k - (k % 7 == 6).cast("int")).cast("string"), F.lit("@x.com")).alias("email"), F.when(k % 5 == 0, "Ada").otherwise("Bob").alias("first_name"), F.lit("Smith").alias("last_name"), F.when(k % 4 == 0, " ").otherwise("Acme").alias("company"), phone.alias("phone"), F.when(k % 9 == 0, "n/a").otherwise("CEO").alias("job_title"), F.when(k % 8 == 0, "not a url").otherwise("acme.com").alias("website"))
    own = c.where("k % 3 <> 0").withColumn("copy", F.explode(F.when(k % 17 == 0, F.array(F.lit("n"), F.lit("z"))).otherwise(F.array(F.lit("n")))))
    existing = own.select(
        F.concat("copy", k.cast("string")).alias("native_id"), F.when(k % 11 == 0, "contact").otherwise("lead").alias("object_type"), F.concat(F.lit("M"), k.cast("string"), F.lit("@x.com ")).alias("email"), (k % 13 == 0).alias("converted"),
        F.when(k % 10 == 0, "Zoe").when(k % 5 == 0, "Ada").otherwise("Bob").alias("first_name"), F.when(k % 10 == 0, "Quill").otherwise("Smith").alias("last_name"), F.when(k % 5 == 0, "").when(k % 5 == 1, "Other").otherwise("Acme").alias("company"),
        F.when(k % 20 == 0, "4125559999").when(k % 2 == 0, "").otherwise(phone).alias("phone"), F.when(k % 6 == 2, "unknown").when(k % 6 == 1, "").otherwise("CEO").alias("job_title"), F.lit("").alias("website"),
    )
    return proposed, existing


def _plan(s, d, **options):
    k, (proposed, existing) = F.col("k"), _people(s, d)
    excluded = _k(s, d).where("k % 23 = 0").select(k.cast("string").alias("contact_id"), F.lit("left out").alias("reason"))
    sure = _k(s, d).where("k % 29 = 0").select(k.cast("string").alias("contact_id"), F.concat(F.lit("n"), (k - (k % 7 == 6).cast("int")).cast("string")).alias("native_id"))
    reviews = _k(s, d).where("k % 6 = 0").select(k.cast("string").alias("contact_id"), F.when(k % 12 == 0, "held").otherwise("clear").alias("status"), F.lit("r").alias("reason"))
    return R.governed_plan(proposed, existing, "salesforce", excluded=excluded, decisions=sure, reviews=reviews, **options)


def _told(plan):
    return plan.select("contact_id", "operation", "reason", "native_id", "matches", F.coalesce(R.decision_text(F.col("decisions")), F.lit("")).alias("decided"))


def _plan_sql(update_only: bool) -> str:
    mode = str(update_only).lower()
    def step(c, before, given, bad):
        return f"""CASE WHEN NOT {mode} AND matches = 0 THEN '{c}:' || CASE WHEN {given} IS NULL THEN 'unchanged' ELSE 'fill' END || ':new_record' WHEN {mode} AND {before} = 'unknown' THEN '{c}:review:suspicious_value' WHEN {mode} AND {given} IS NOT NULL AND {bad} THEN '{c}:review:invalid_value' WHEN {before} IS NOT DISTINCT FROM {given} THEN NULL WHEN {given} IS NULL THEN '{c}:preserve:blank_import' WHEN {before} IS NOT NULL THEN '{c}:preserve:populated' ELSE '{c}:fill:fill_empty' END"""
    fields = [("first_name", "bf", "gf", "false"), ("last_name", "bl", "'Smith'", "false"), ("company", "bc", "gc", "false"), ("phone", "bp", "gp", "false"), ("job_title", "bj", "gj", "k % 9 = 0"), ("website", "NULL", "gw", "k % 8 = 0")]
    return f"""WITH i AS (SELECT c_custkey k, c_custkey - CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 0 END t FROM customer),
m AS (SELECT *, CASE WHEN t % 3 = 0 OR t NOT IN (SELECT c_custkey FROM customer) THEN 0 WHEN t % 17 = 0 THEN 2 ELSE 1 END matches, k % 23 = 0 out FROM i),
c AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'Ada' ELSE 'Bob' END gf, CASE WHEN k % 4 = 0 THEN NULL ELSE 'Acme' END gc, '412555' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') gp, CASE WHEN k % 9 = 0 THEN 'n/a' ELSE 'CEO' END gj, CASE WHEN k % 8 = 0 THEN 'not a url' ELSE 'acme.com' END gw,
 CASE WHEN t % 10 = 0 THEN 'Zoe' WHEN t % 5 = 0 THEN 'Ada' ELSE 'Bob' END bf, CASE WHEN t % 10 = 0 THEN 'Quill' ELSE 'Smith' END bl, CASE WHEN t % 5 = 0 THEN NULL WHEN t % 5 = 1 THEN 'Other' ELSE 'Acme' END bc, CASE WHEN t % 20 = 0 THEN '4125559999' WHEN t % 2 = 0 THEN NULL ELSE '412555' || lpad(CAST(t % 10000 AS VARCHAR), 4, '0') END bp, CASE WHEN t % 6 = 2 THEN 'unknown' WHEN t % 6 = 1 THEN NULL ELSE 'CEO' END bj,
 count(*) FILTER (WHERE NOT out AND matches = 1) OVER (PARTITION BY t) claims FROM m),
h AS (SELECT *, CASE WHEN out THEN 'excluded' WHEN matches > 1 THEN 'several_matches' WHEN k % 29 = 0 AND matches <> 1 THEN 'confirmed_match_gone' WHEN matches = 0 AND k % 12 = 0 THEN 'create_review_held' WHEN matches = 0 AND {mode} THEN 'no_match' WHEN matches = 1 AND claims > 1 THEN 'shared_target' WHEN matches = 1 AND t % 11 = 0 THEN 'existing_contact' WHEN matches = 1 AND t % 13 = 0 THEN 'converted_lead'
 WHEN {mode} AND matches = 1 AND k % 29 <> 0 AND t % 10 = 0 AND ((gc IS NOT NULL AND bc IS NOT NULL AND gc <> bc) OR (bp IS NOT NULL AND bp <> gp)) THEN 'contradiction' END reason FROM c),
x AS (SELECT *, CASE WHEN reason IS NULL THEN concat_ws('|', {', '.join(step(*f) for f in fields)}) ELSE '' END decided FROM h)
SELECT CAST(k AS VARCHAR) contact_id, CASE WHEN reason IS NOT NULL THEN 'hold' WHEN matches = 0 THEN 'create' WHEN contains(decided, 'fill_empty') THEN 'update' ELSE 'unchanged' END operation, reason, CASE WHEN reason IS NULL AND matches = 1 THEN 'n' || t END native_id, CAST(matches AS BIGINT) matches, decided FROM x"""


def _classified(s, d):
    rows = C.flagged(contacts(s, d)).withColumn("record_status", F.when(F.substring("contact_id", 10, 1) == "7", "merged").otherwise("active")).where("contact_id NOT LIKE '%8'")
    k = F.substring("contact_id", 3, 8).cast("long")
    plan = rows.where(k % 6 != 0).select("contact_id", F.when(k % 4 == 0, "update").when(k % 4 == 1, "unchanged").otherwise("hold").alias("operation"), F.when(k % 4 == 2, "no_match").when(k % 4 == 3, "several_matches").alias("reason"))
    return R.classified(rows, plan, rows.where(k % 9 == 0).select("contact_id"), contacts(s, d).where("contact_id LIKE '%8' OR contact_id LIKE '%1'"))


def _report(s, d):
    k = F.col("k")
    c, text = _k(s, d), F.col("k").cast("string")
    plan = c.where("k % 5 <> 0").select(text.alias("contact_id"), F.when(k % 3 == 0, "create").otherwise("update").alias("operation"), F.when(k % 3 != 0, F.concat(F.lit("n"), text)).alias("native_id"), F.when(k % 2 == 0, "=why").alias("reason"))
    receipts = c.where("k % 4 <> 0").select(text.alias("contact_id"), F.when(k % 3 == 0, "created").when(k % 7 == 0, "failed").otherwise("updated").alias("status"), F.concat(F.lit("n"), text).alias("native_id"), F.when(k % 7 == 0, "late").otherwise("").alias("error"))
    checks = c.where("k % 2 = 1").select(text.alias("contact_id"), F.concat(F.when(k % 9 == 0, "o").otherwise("n"), text).alias("native_id"), F.lit("verified").alias("status"))
    return R.review_rows(plan, receipts, checks)


_REPORT = """c AS (SELECT c_custkey k, CAST(c_custkey AS VARCHAR) id, c_custkey % 5 <> 0 p, c_custkey % 4 <> 0 r FROM customer),
rep AS (SELECT id contact_id, CASE WHEN p THEN CASE WHEN k % 3 = 0 THEN 'create' ELSE 'update' END END planned_action, CASE WHEN NOT r THEN 'no_receipt' WHEN k % 3 = 0 THEN 'created' WHEN k % 7 = 0 THEN 'failed' ELSE 'updated' END outcome, CASE WHEN r OR k % 3 <> 0 THEN 'n' || id END native_id, CASE WHEN r AND k % 7 = 0 THEN 'late' WHEN p AND k % 2 = 0 THEN '=why' ELSE '' END reason,
 CASE WHEN p AND r AND (k % 3 = 0 OR k % 7 <> 0) AND k % 2 = 1 AND k % 9 <> 0 THEN 'verified' END verification_status FROM c WHERE p OR r)"""


def _rollbacks(s, d):
    k = F.substring("native_id", 2, 20).cast("long")
    _, existing = _people(s, d)
    plan = _plan(s, d)
    filled = plan.where("operation = 'update'").select("native_id", F.map_from_entries(F.transform(F.filter("decisions", lambda x: ~x["before"].eqNullSafe(x["after"])), lambda x: F.struct(x["field"], x["after"]))).alias("put"))
    now = existing.where(k % 19 != 0).join(filled, "native_id", "left")
    put = lambda c: F.when(k % 3 == 1, F.coalesce(F.col("put")[c], F.col(c))).when((k % 3 == 2) & (k % 4 == 0) & F.map_contains_key("put", F.lit(c)), "edited").otherwise(F.col(c))
    return R.rollbacks(plan, now.select("native_id", *(put(c).alias(c) for c in R.FIELDS)))


def _repaired(s, d):
    before = C.flagged(contacts(s, d))
    after = C.replay(C.reroute(C.merge(before)).drop("last_action"))
    return R.decision_report(before, after, C.BLOCKING)


_B = "'invalid_email','duplicate_identity','missing_company','missing_owner','stage_regression'"


def _monitored(s, d):
    k = F.col("k")
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (n + 1).cast("int"))
    provider = F.when(k % 4 == 0, "salesforce").otherwise("hubspot")
    kind = F.when(k % 10 == 9, "Company").when(k % 3 == 0, "Contact").when(k % 3 == 1, "Lead")
    mail = F.when(k % 6 == 0, " ").when(k % 6 == 1, "bad").otherwise("a@x.com")
    full = F.create_map(F.lit("email"), mail, F.lit("lifecyclestage"), pick(("lead", "salesqualifiedlead", "customer", "other"), k % 4), F.lit("hubspot_owner_id"), F.when(k % 5 == 0, "").otherwise("o1"), F.lit("company"), F.when(k % 7 == 0, " Acme ").otherwise("Acme"), F.lit("jobtitle"), F.when(k % 8 == 0, "CEO ").otherwise("CEO"))
    small = F.create_map(F.lit("jobtitle"), F.lit("CEO"), F.lit("lifecyclestage"), F.lit("lead"))
    records = _k(s, d).select(k.alias("record_id"), provider.alias("provider"), kind.alias("object_type"), F.when(k % 12 == 11, small).otherwise(full).alias("props"))
    previous = _k(s, d).where("k % 2 = 1").select(k.alias("record_id"), pick(("opportunity", "lead", "odd"), k % 3).alias("high_water"))
    return records, previous


def _issues(s, d):
    return M.issues(*_monitored(s, d)).select("record_id", "rule", "severity", F.to_json("before").alias("before"), F.to_json("after").alias("after"))


_MON = """r AS (SELECT c_custkey k, c_custkey % 4 = 0 sf, CASE WHEN c_custkey % 10 = 9 THEN 'Company' WHEN c_custkey % 3 = 0 THEN 'Contact' WHEN c_custkey % 3 = 1 THEN 'Lead' END o, c_custkey % 12 = 11 small,
 CASE WHEN c_custkey % 12 = 11 THEN 'lead' ELSE (['lead','salesqualifiedlead','customer','other'])[c_custkey % 4 + 1] END st, CASE WHEN c_custkey % 2 = 1 THEN (['opportunity','lead','odd'])[c_custkey % 3 + 1] END high FROM customer),
q AS (SELECT *, CASE WHEN sf THEN -1 ELSE coalesce(list_position(['subscriber','lead','marketingqualifiedlead','salesqualifiedlead','opportunity','customer','evangelist'], st), 0) - 1 END now, coalesce(list_position(['subscriber','lead','marketingqualifiedlead','salesqualifiedlead','opportunity','customer','evangelist'], high), 0) - 1 was FROM r)"""


def _states(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("record_id"), F.col("ts").alias("at"), F.col("event_type").alias("condition"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("x").alias("required"))


def _groups(s, d):
    e = table(s, d, "events")
    return N.grouped(e.select(F.when(F.col("event_id") % 2 == 0, "clear").otherwise("reversal").alias("kind"), F.lit("Contact").alias("object_type"), F.col("event_type").alias("field"), F.col("user_id").alias("record_id"), F.col("ts").alias("at")))


def _timeline(s, d):
    k = F.col("k")
    c = _k(s, d)
    old = c.where("k % 3 <> 0").select(k.alias("fingerprint"), (k % 5).alias("version"), F.when(k % 4 == 0, "resolved").when(k % 4 == 1, "acknowledged").otherwise("open").alias("status"), (k % 37).alias("records"))
    return N.timeline(old, c.where("k % 5 <> 0").select(k.alias("fingerprint"), (k % 50).alias("records")))


def _deals(s, d):
    k = F.col("k")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    return N.invalid_deals(_k(s, d).select(k.alias("record_id"), pick(("12.50", "", "+3", "-4", "1e3", ".5", "abc", "7.")).alias("amount"), pick(("2024-02-29", "2023-02-29", "2024-13-01", "", "2024-01-05T10:00:00Z", "05/01/2024", "2024-1-5")).alias("close_date")), True)


def _coverage(s, d):
    k = F.col("k")
    props = lambda drop: F.map_filter(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")), lambda key, v: key != drop)
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("a", "b", "c", "-"))), (n % 4 + 1).cast("int"))
    out = N.field_coverage(_k(s, d).select(k.alias("record_id"), props(pick(k)).alias("properties")), _k(s, d).select(k.alias("record_id"), props(pick(F.floor(k / 4))).alias("properties")))
    return out.select("record_id", F.array_join("added", "|").alias("added"), F.array_join("absent", "|").alias("absent"))


def _links(s, d):
    k = F.col("k")
    value = F.when(k % 5 == 0, " ").when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat(F.lit('["'), k.cast("string"), F.lit('","x","x"]'))).when(k % 5 == 3, "[1,").otherwise('["a",""]')
    ids = N.relationship_ids(F.col("v"))
    return _k(s, d).withColumn("v", value).select(k.alias("record_id"), F.array_join(ids, "|").alias("ids"))


QUERIES = {
    "crm_eligibility": lambda s, d: _saved(s, d).select("contact_id", R.eligible("hubspot").alias("hubspot"), R.eligible("salesforce").alias("salesforce")),
    "portable_values": lambda s, d: R.portable(_saved(s, d).where(R.eligible("hubspot")), "salesforce").withColumn("too_long", F.array_join("too_long", "|")),
    "batch_faults": lambda s, d: R.batch_faults(_batches(s, d)),
    "snapshot_gate": lambda s, d: _scans(s, d).select("scan_id", R.snapshot_issue("w1", "hubspot", F.lit(AS_OF)).alias("issue")),
    "create_reviews": _creates,
    "match_validity": _decisions,
    "shared_claims": _claims,
    "governed_plan": lambda s, d: _told(_plan(s, d)),
    "governed_plan_with_creates": lambda s, d: _told(_plan(s, d, update_only=False)),
    "import_classification": _classified,
    "review_report": _report,
    "review_lines": lambda s, d: R.report_lines(_report(s, d), ("contact_id", "outcome", "reason")),
    "rollback_states": _rollbacks,
    "decision_report": _repaired,
    "monitor_issues": _issues,
    "monitor_high_water": lambda s, d: M.high_waters(*_monitored(s, d)),
    "expectations_due": lambda s, d: N.expectations_due(_states(s, d), ("click", "signup"), 60, AS_OF),
    "incident_groups": _groups,
    "incident_timeline": _timeline,
    "invalid_deals": _deals,
    "field_coverage": _coverage,
    "relationship_values": _links,
}
_rows = "k AS (SELECT c_custkey k, CAST(c_custkey AS VARCHAR) id FROM customer)"
ORACLES = {
    "crm_eligibility": F_SQL + f", {_SAVED} SELECT contact_id, {_HUB} hubspot, {_HUB} AND length(normalized_email) <= 80 AND trim(company) <> '' salesforce FROM s",
    "portable_values": F_SQL + f", {_SAVED} SELECT contact_id, normalized_email email, split_part(full_name, ' ', 1) first_name, CASE WHEN k % 5 = 0 THEN 'Quill' ELSE split_part(full_name, ' ', 2) END last_name, nullif(trim(company), '') company, CASE WHEN k % 7 = 0 THEN repeat('5', 40) WHEN k % 3 <> 0 THEN '412' || k END phone, CAST(NULL AS VARCHAR) job_title, CASE WHEN k % 2 = 0 THEN 'x.com' END website, CASE WHEN k % 7 = 0 THEN 'phone' ELSE '' END too_long FROM s WHERE {_HUB}",
    "batch_faults": f"WITH {_rows} SELECT batch, count(*) AS rows, CASE WHEN count(*) > 100 THEN 'size' WHEN count(DISTINCT i) < count(*) THEN 'repeated_id' WHEN count(DISTINCT m) < count(*) THEN 'repeated_email' END fault FROM (SELECT k // 60 batch, CASE WHEN k % 180 = 7 THEN k - 1 ELSE k END i, CASE WHEN k % 180 = 70 THEN k - 1 ELSE k END m FROM k) GROUP BY 1",
    "snapshot_gate": f"WITH {_rows} SELECT k scan_id, CASE WHEN k % 9 = 0 OR k % 8 = 0 THEN 'other_source' WHEN k % 7 = 0 OR k % 5 = 0 THEN 'incomplete' WHEN (k % 50 - 3) * 30 < 0 OR (k % 50 - 3) * 30 > 900 THEN 'stale' END issue FROM k",
    "create_reviews": f"WITH {_rows}, r AS (SELECT id contact_id, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END crm_candidates, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END import_candidates, CASE WHEN k % 11 = 0 THEN 'no_saved_identity' WHEN k % 5 = 0 OR k % 7 = 0 THEN 'possible_duplicates' END reason FROM k) SELECT *, CASE WHEN reason IS NULL THEN 'clear' ELSE 'held' END status FROM r",
    "match_validity": f"WITH {_rows} SELECT id contact_id, 'n' || id native_id, CASE WHEN k % 13 = 0 OR (k % 6 = 0 AND k % 4 <> 0) THEN 'row_changed' WHEN k % 9 = 0 OR k % 10 = 0 THEN 'target_changed' END fault FROM k",
    "shared_claims": f"WITH {_rows}, e AS (SELECT k n, k m FROM k WHERE k % 3 = 0 UNION SELECT k, k + 1 FROM k WHERE k % 6 = 0), c AS (SELECT n, m FROM e WHERE m IN (SELECT k FROM k) UNION SELECT k + 1, k FROM k WHERE k % 30 = 2) SELECT n native_id, CAST(m AS VARCHAR) contact_id FROM (SELECT *, count(*) OVER (PARTITION BY n) z FROM c) WHERE z > 1",
    "governed_plan": _plan_sql(True),
    "governed_plan_with_creates": _plan_sql(False),
    "import_classification": F_SQL + f""", z AS (SELECT *, CAST(contact_id[3:] AS BIGINT) k, contact_id LIKE '%7' mg FROM f WHERE contact_id NOT LIKE '%8'),
g AS (SELECT contact_id, CASE WHEN mg THEN 'skipped' WHEN NOT (ok) THEN 'held' WHEN k % 6 = 0 THEN 'unresolved' WHEN k % 9 = 0 THEN 'held' WHEN k % 4 = 0 THEN 'proposed_update' WHEN k % 4 = 1 THEN 'unchanged' WHEN k % 4 = 2 THEN 'unmatched' ELSE 'held' END status, CASE WHEN mg THEN 'merged_or_excluded' WHEN NOT ok THEN 'flags' WHEN k % 6 = 0 THEN 'not_checked' WHEN k % 9 = 0 THEN 'shared_target' WHEN k % 4 = 2 THEN 'no_match' WHEN k % 4 = 3 THEN 'several_matches' ELSE '' END reason FROM (SELECT *, {_HUB} ok FROM z))
SELECT * FROM g UNION ALL SELECT contact_id, 'skipped', 'removed' FROM contacts WHERE contact_id LIKE '%8'""",
    "review_report": f"WITH {_REPORT} SELECT * FROM rep",
    "review_lines": f"""WITH {_REPORT} SELECT contact_id, '"' || contact_id || '","' || outcome || '","' || CASE WHEN reason LIKE '=%' THEN '''' ELSE '' END || reason || '"' line FROM rep""",
    "rollback_states": f"WITH p AS ({_plan_sql(True)}) SELECT contact_id, native_id, CASE WHEN t % 19 = 0 THEN 'missing' WHEN t % 3 = 1 THEN 'restorable' WHEN t % 4 = 0 THEN 'changed' ELSE 'restored' END state FROM (SELECT *, CAST(native_id[2:] AS BIGINT) t FROM p WHERE operation = 'update')",
    "decision_report": F_SQL + f""", m AS (SELECT *, list_contains(fl, 'duplicate_identity') d, first_value(contact_id) OVER (PARTITION BY normalized_email ORDER BY CAST(raw_email <> lower(trim(raw_email)) AS INTEGER), contact_id) canon FROM f),
o AS (SELECT *, d AND canon <> contact_id gone FROM m), a AS (SELECT *, lower(region) = 'northeast' AND lower(segment) = 'enterprise' AND owner_id <> 'NE-ENT-OVERFLOW' AND NOT gone rr, list_contains(fl, 'stage_regression') AND NOT gone rp FROM o),
b AS (SELECT *, list_filter(fl, lambda x: NOT (x = 'duplicate_identity' AND d AND NOT gone) AND NOT (x = 'missing_owner' AND rr) AND NOT (x = 'stage_regression' AND rp)) now FROM a),
h AS (SELECT canon, string_agg(contact_id, '|' ORDER BY contact_id) ids FROM b WHERE gone GROUP BY 1),
z AS (SELECT b.*, ids, list_filter(now, lambda x: x IN ({_B})) holds FROM b LEFT JOIN h ON b.contact_id = h.canon)
SELECT contact_id, CASE WHEN gone THEN 'Merged' WHEN len(holds) = 0 THEN 'Ready' ELSE 'Held' END status, coalesce(ids, '') merged_from, concat_ws('|', CASE WHEN rr THEN 'owner_id' END, CASE WHEN rp AND lifecycle_stage <> expected_lifecycle_stage THEN 'lifecycle_stage' END, CASE WHEN gone THEN 'record_status' END) changed, CASE WHEN NOT gone AND len(holds) > 0 THEN array_to_string(holds, '|') ELSE '' END hold_flags, array_to_string(list_filter(now, lambda x: x NOT IN ({_B})), '|') information FROM z""",
    "monitor_issues": f"""WITH {_MON}, p AS (SELECT * FROM q WHERE o IS NULL OR o <> 'Company')
SELECT k record_id, 'email_missing' rule, 'critical' severity, '{{"email":" "}}' AS before, '{{}}' AS after FROM p WHERE NOT small AND k % 6 = 0
UNION ALL SELECT k, 'email_invalid', 'critical', '{{"email":"bad"}}', '{{}}' FROM p WHERE NOT small AND k % 6 = 1
UNION ALL SELECT k, 'owner_missing', 'warning', '{{"lifecyclestage":"' || st || '","hubspot_owner_id":""}}', '{{}}' FROM p WHERE NOT small AND NOT sf AND st IN ('salesqualifiedlead', 'opportunity', 'customer') AND k % 5 = 0
UNION ALL SELECT k, 'lifecycle_regression', 'critical', '{{"lifecyclestage":"' || high || '"}}', '{{"lifecyclestage":"' || st || '"}}' FROM p WHERE now >= 0 AND was >= 0 AND now < was
UNION ALL SELECT k, 'text_whitespace', 'warning', '{{' || concat_ws(',', CASE WHEN c THEN '"company":" Acme "' END, CASE WHEN j THEN '"jobtitle":"CEO "' END) || '}}', '{{' || concat_ws(',', CASE WHEN c THEN '"company":"Acme"' END, CASE WHEN j THEN '"jobtitle":"CEO"' END) || '}}' FROM (SELECT k, k % 7 = 0 AND NOT (sf AND o IS NOT DISTINCT FROM 'Contact') c, k % 8 = 0 j FROM p WHERE NOT small) WHERE c OR j""",
    "monitor_high_water": f"WITH {_MON} SELECT k record_id, CASE WHEN (o IS NULL OR o <> 'Company') AND now >= 0 THEN CASE WHEN was > now THEN high ELSE st END END high_water FROM q",
    "expectations_due": """WITH s AS (SELECT user_id record_id, ts, event_type IN ('click', 'signup') AND event_id % 2 = 0 unmet FROM events), m AS (SELECT record_id, max(ts) FILTER (WHERE NOT unmet) met FROM s GROUP BY 1)
SELECT record_id, min(ts) since FROM s JOIN m USING (record_id) WHERE unmet AND (met IS NULL OR ts > met) GROUP BY 1 HAVING floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(min(ts))) >= 3600""",
    "incident_groups": "SELECT CASE WHEN event_id % 2 = 0 THEN 'clear' ELSE 'reversal' END || ':Contact:' || event_type fingerprint, count(DISTINCT user_id) records, min(ts) first_at, max(ts) last_at FROM events GROUP BY 1",
    "incident_timeline": """WITH o AS (SELECT c_custkey k, c_custkey % 5 v, CASE c_custkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' ELSE 'open' END was, c_custkey % 37 had FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey k, c_custkey % 50 r FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT coalesce(o.k, n.k) fingerprint, v, was, had, r FROM o FULL JOIN n ON o.k = n.k)
SELECT fingerprint, CASE WHEN r IS NULL THEN v ELSE coalesce(v, 0) + 1 END AS version, CASE WHEN r IS NULL OR was IN ('open', 'acknowledged') THEN was ELSE 'open' END status, greatest(coalesce(r, 0), coalesce(had, 0)) records, CASE WHEN r IS NULL THEN NULL WHEN was IS NULL THEN 'detected' WHEN was = 'resolved' THEN 'reopened' WHEN r > had AND r >= 10 AND floor(log2(r / 10.0)) > floor(log2(greatest(10, had) / 10.0)) THEN 'scope_expanded' END event FROM j""",
    "invalid_deals": "SELECT c_custkey record_id, 'amount' field FROM customer WHERE c_custkey % 8 IN (3, 4, 6) UNION ALL SELECT c_custkey, 'close_date' FROM customer WHERE c_custkey % 7 IN (1, 2, 5, 6)",
    "field_coverage": "SELECT record_id, CASE WHEN w <> '-' THEN w ELSE '' END added, CASE WHEN n <> '-' THEN n ELSE '' END absent FROM (SELECT c_custkey record_id, (['a','b','c','-'])[c_custkey % 4 + 1] w, (['a','b','c','-'])[c_custkey // 4 % 4 + 1] n FROM customer) WHERE w <> n",
    "relationship_values": "SELECT c_custkey record_id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN c_custkey || '|x' END ids FROM customer",
}
