"""Registered queries of what arrives from CRMs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intake as N
from tidemark.operators import routing as R
from tidemark.operators import state as S
from tidemark.sources import csv_files
from tidemark.sources.views import table

AS_OF = "2024-02-01 00:00:00"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _k(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"))


def _provider(s, d):
    k = F.col("k")
    t = k.cast("string")
    rows = _k(s, d).select(
        t.alias("native_id"), F.when(k % 4 == 0, "lead").otherwise("contact").alias("object_type"), F.when(k % 3 == 0, F.lit(None)).otherwise("Ada").alias("first_name"), F.lit("Smith").alias("last_name"), F.concat(t, F.lit("@x.com")).alias("email"),
        F.when(k % 5 == 0, "a@x.com; b@x.com;;a@x.com").alias("other_emails"), F.lit("Acme").alias("company"), F.when(k % 2 == 0, "").otherwise(t).alias("phone"), F.when(k % 7 != 0, F.concat(F.lit("9"), t)).alias("mobile"), F.lit(None).cast("string").alias("job_title"), F.lit("x.com").alias("website"),
    )
    return N.canonical(rows, "crm").select("record_key", "full_name", F.array_join("additional_emails", "|").alias("additional_emails"), "phone", "secondary_phone")


def _records(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("modified"))


def _accounts(s, d):
    k = F.col("k")
    back = lambda n: _now() - F.make_dt_interval(secs=n)
    return _k(s, d).select(k.alias("account_id"), F.when(k % 6 != 0, back((k % 1000).cast("decimal(18,6)"))).alias("watermark"), F.when(k % 5 != 0, back((k * 97 % 100_000).cast("decimal(18,6)"))).alias("reconciled_at"), F.when(k % 4 == 0, F.lit(10_000).cast("long")).otherwise(k).alias("waiting"))


def _linked(s, d):
    k = F.col("k")
    links = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("o"), (F.col("o_orderkey") % 50).cast("string")).alias("target"))
    return N.linked(_k(s, d).select(k.alias("id")), links, _k(s, d).where("k % 9 <> 0").select(k.alias("id")))


def _webhooks(s, d):
    k = F.col("k")
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))
    sub = pick(("contact.creation", "company.propertyChange", "deal.deletion", "contact.associationChange", "company.merge", "ticket.creation", "deal.other", "contact.creation.x"), k)
    t = k.cast("string")
    return _k(s, d).select(
        k.alias("event_id"), sub.alias("subscription"), F.when(k % 11 != 0, t).alias("object_id"), pick(("CONTACT_TO_COMPANY", "CONTACT_TO_CONTACT", "CONTACT_TO_TICKET", ""), F.floor(k / 8)).alias("association_type"), F.when(k % 5 != 0, t).alias("from_id"), F.when(k % 3 == 0, t).otherwise(F.concat(F.lit("z"), t)).alias("to_id"),
        F.when(k % 7 != 0, True).alias("removed"), F.when(k % 2 == 0, F.concat(F.lit("p"), t)).alias("primary_id"), F.when(k % 6 == 0, F.concat(F.lit("n"), t)).alias("new_id"), F.array(t).alias("merged_ids"),
    )


def _changes(s, d):
    k = F.col("k")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    t = k.cast("string")
    return _k(s, d).select(k.alias("event_id"), pick(("Lead", "Contact", "Account")).alias("entity"), pick(("CREATE", "UPDATE", "DELETE", "UNDELETE", "GAP_UPDATE")).alias("change_type"), F.array(t, F.when(k % 13 == 0, F.concat(t, F.lit("*"))).otherwise(F.concat(t, F.lit("b")))).alias("record_ids"))


def _queue(s, d):
    e = table(s, d, "events")
    i = F.col("event_id")
    at = F.col("ts").cast("timestamp_ntz")
    return e.select(i.alias("id"), (F.col("user_id") % 7).alias("account_id"), at.alias("received_at"), F.when(i % 3 == 0, at).alias("processed_at"), (i % 11 == 0).alias("held"), (i % 4).alias("attempts"), F.when(i % 5 == 0, _now() + F.expr("INTERVAL 1 HOURS")).alias("next_attempt_at"))


_QUEUE = "q AS (SELECT event_id id, user_id % 7 account_id, ts received_at, CASE WHEN event_id % 3 = 0 THEN ts END processed_at, event_id % 11 = 0 held, event_id % 4 attempts, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01 01:00:00' END next_attempt_at FROM events)"


def _native(s, d):
    e = table(s, d, "events")
    i = F.col("event_id")
    return e.select(F.col("user_id").alias("record_id"), F.lit("owner").alias("field"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("at"), F.concat(F.lit("o"), (i % 3).cast("string")).alias("value"), (i % 97 == 0).alias("planned"))


def _findings(s, d):
    k = F.col("k")
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("open", "resolved", "acknowledged"))), (n % 3 + 1).cast("int"))
    return N.intents(_k(s, d).where("k % 10 <> 0").select(k.alias("id"), pick(k).alias("status"), (k % 4).alias("occurrences")), _k(s, d).select(k.alias("id"), pick(F.floor(k / 2)).alias("status"), (k % 4 + F.when(k % 8 == 0, 1).otherwise(0)).alias("occurrences")))


def _budget(s, d):
    e = table(s, d, "events")
    newest = F.lit("2024-01-31 00:00:00")
    return N.budget(e.select((F.col("user_id") % 3).alias("account_id"), (F.col("user_id") % 40).alias("record_id"), F.col("ts").alias("started_at")), newest.cast("timestamp_ntz"), 12, 9)


def _policies(s, d):
    k = F.col("k")
    t = k.cast("string")
    found = _k(s, d).select(k.alias("incident_id"), (k % 20).alias("account_id"), (k % 5).alias("version"))
    accounts = _k(s, d).where("k < 18")
    history = accounts.select(k.alias("account_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("version")).withColumn("policy", F.concat_ws("v", F.col("account_id").cast("string"), F.col("version").cast("string")))
    return N.policy_at(found, history, accounts.select(k.alias("account_id"), F.concat(F.lit("now"), t).alias("policy")))


def _recent(s, d):
    o = table(s, d, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("record_key"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string")))).alias("related"), F.col("o_orderdate").alias("received_at"))
    return N.recent_events(e, _k(s, d).where("k % 40 = 0").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("record_key"))).select("id", "record_key")


def _uploads(s, d):
    k = F.col("k")
    files = _k(s, d).select((k % 2).alias("provider"), F.concat(F.lit("f"), k.cast("string")).alias("path"), (k % 30).cast("string").cast("binary").alias("content"))
    return N.new_uploads(files, _k(s, d).where("k < 10").select((k % 2).alias("provider"), F.sha2(k.cast("string").cast("binary"), 256).alias("digest")))


def _world(s, d):
    """Requests, leads, accounts and reps."""
    k = F.col("k")
    t = k.cast("string")
    c = _k(s, d)
    company = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Corp "), (k % 60).cast("string")))
    requests = c.select(t.alias("request_id"), F.lit("Ada").alias("first_name"), F.when(k % 17 == 0, " ").otherwise("Smith").alias("last_name"), company.alias("company"), F.concat(F.lit("P"), t, F.lit("@d"), F.when(k % 7 == 0, k % 50).otherwise(k % 60).cast("string"), F.lit(".com")).alias("email"), F.when(k % 3 == 0, "").otherwise("West").alias("region"), F.when(k % 11 == 0, -1).otherwise(k * 100).alias("spend"), F.lit("p").alias("payload"))
    leads = c.where("k % 4 = 0").select(F.concat(F.lit("l"), t).alias("lead_id"), F.concat(F.lit("p"), t, F.lit("@d"), (k % 60).cast("string"), F.lit(".com")).alias("email"), F.when(k % 60 < 40, F.when(k % 8 == 0, k % 60)).alias("account_id"), F.when(k % 12 == 0, F.concat(F.lit("r"), (k % 5).cast("string"))).alias("owner_id"))
    accounts = c.where("k < 40").select(k.alias("account_id"), F.concat(F.lit("CORP-"), t).alias("name"), F.concat(F.lit("d"), t, F.lit(".com")).alias("domain"), F.when(k % 2 == 0, "East").alias("region"), F.when(k % 5 == 0, F.lit(None)).otherwise(k * 1000).alias("spend"), F.when(k % 6 == 0, F.concat(F.lit("r"), (k % 5).cast("string"))).alias("owner_id"))
    reps = c.where("k < 5").select(F.concat(F.lit("r"), t).alias("rep_id"), (k != 3).alias("active"))
    return requests, leads, accounts, reps


_WORLD = f"""w AS (SELECT c_custkey k, CAST(c_custkey AS VARCHAR) t, c_custkey % 60 co, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 50 ELSE c_custkey % 60 END dm FROM customer),
lead AS (SELECT t, co, CASE WHEN co < 40 AND k % 8 = 0 THEN co END acc, CASE WHEN k % 12 = 0 THEN 'r' || (k % 5) END own FROM w WHERE k % 4 = 0)"""


def _inbound(s, d):
    requests, leads, accounts, reps = _world(s, d)
    return R.inbound(requests, leads, accounts, reps)


def _pools(s, d):
    """The pool's requests by their id, over five reps a pool of whom some are full, away or without a place."""
    requests, leads, accounts, _ = _world(s, d)
    k = F.col("k")
    reps = _k(s, d).where("k < 60").select(F.concat(F.lit("s"), k.cast("string")).alias("rep_id"), F.when(k % 3 == 0, "East").when(k % 3 == 1, "West").alias("region"), F.when(k % 2 == 0, "Enterprise").otherwise("Growth").alias("segment"), (k % 7 != 0).alias("active"), (k % 11 + k % 4).alias("capacity"), (k % 5).alias("assigned"))
    pool = R.inbound(requests, leads, accounts, reps.select("rep_id", "active")).where("status = 'pool'")
    return R.assign(pool.select(F.col("request_id").cast("long").alias("seq"), "request_id", "region", "segment"), reps)


def _intake(s, d, create):
    k, (requests, leads, accounts, reps) = F.col("k"), _world(s, d)
    contacts = _k(s, d).where("k % 10 = 3").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(F.lit("p"), k.cast("string"), F.lit("@d"), F.when(k % 7 == 0, k % 50).otherwise(k % 60).cast("string"), F.lit(".com")).alias("email"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("owner_id"), F.when(k % 20 == 3, k % 40).alias("account_id"))
    more = contacts.where("id LIKE '%93'").withColumn("id", F.concat(F.lit("z"), "id"))
    forms = requests.union(requests.where("request_id LIKE '%99'").withColumn("payload", F.lit("q")))
    leads = leads.select(F.col("lead_id").alias("id"), "email", "owner_id", F.when(F.col("lead_id").endswith("6"), "Other").otherwise(F.concat(F.lit("corp"), F.regexp_extract("email", r"@d(\d+)", 1))).alias("company"))
    return R.intake(forms, contacts.union(more), leads, accounts, reps.select(F.col("rep_id").alias("user_id"), "active"), create)


def _intake_sql(create: bool) -> str:
    on = str(create).lower()
    return f"""WITH {_WORLD}, c AS (SELECT w.*, k % 10 = 3 hc, k % 100 = 93 twice, lead.t IS NOT NULL AND dm = w.co hl, lead.own lown, k % 20 = 3 ca, CASE WHEN k % 13 = 0 THEN NULL WHEN w.co < 40 THEN w.co END ac FROM w LEFT JOIN lead USING (t)),
x AS (SELECT *, {on} AND (NOT hc OR NOT ca) wants, CASE WHEN ac % 6 = 0 THEN 'r' || (ac % 5) END aown, CASE WHEN (k % 40) % 6 = 0 THEN 'r' || (k % 40 % 5) END cown FROM c),
y AS (SELECT *, CASE WHEN hc THEN CASE WHEN wants THEN 'attach_contact' ELSE 'reuse_contact' END WHEN hl THEN CASE WHEN wants THEN 'convert_lead' ELSE 'reuse_lead' END WHEN wants THEN 'create_contact' ELSE 'create_lead' END act, CASE WHEN wants THEN ac WHEN hc AND ca THEN k % 40 END acc,
 CASE WHEN wants THEN coalesce(aown, CASE WHEN hl THEN lown END) WHEN hc THEN CASE WHEN {on} THEN coalesce(cown, 'r' || (k % 5)) ELSE 'r' || (k % 5) END WHEN hl THEN lown END own FROM x),
z AS (SELECT *, CASE WHEN t LIKE '%99' THEN 'payload_conflict' WHEN twice OR (hc AND hl) THEN 'several_people' WHEN act = 'convert_lead' AND (t LIKE '%6' OR k % 13 = 0) THEN 'lead_company' WHEN own = 'r3' THEN 'owner_inactive' END reason FROM y)
SELECT t request_id, CASE WHEN reason IS NULL THEN act ELSE 'hold' END AS action, reason, CASE WHEN reason IS NULL THEN CASE WHEN hc THEN 'c' || t WHEN hl THEN 'l' || t END END person_id, CASE WHEN reason IS NULL THEN acc END account_id, CASE WHEN reason IS NULL THEN own END owner_id FROM z"""


def _triage(s, d):
    k = F.col("k")
    c = _k(s, d)
    items = c.select(k.alias("id"), (k % 4).alias("version"), F.when(k % 3 == 0, "open").otherwise("resolved").alias("status"), F.when(k % 5 == 0, "ada").alias("assignee"))
    patches = c.where("k % 2 = 0").select(k.alias("id"), (k % 8 % 5).alias("expected_version"), F.when(k % 6 == 0, F.lit(None)).otherwise("acknowledged").alias("status"), F.when(k % 10 == 0, "bo").alias("assignee"))
    return S.triage(items, patches)


def _undo(s, d):
    o = table(s, d, "orders")
    return S.undo(o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("payload")))


def _groups(s, d):
    """Rows of seven files; a file's emails and cells repeat up to white space and case, and every 31st row has neither."""
    k = F.col("k")
    mail = F.when(k % 31 == 0, " ").otherwise(F.concat(F.when(k % 2 == 0, "A").otherwise("a"), (k % 20).cast("string"), F.lit("@x.com ")))
    docs = _k(s, d).select(F.concat(F.lit("f"), (k % 7).cast("string")).alias("path"), k.alias("row_id"), F.array(F.concat(F.when(k % 3 == 0, " ").otherwise(""), (k % 40).cast("string")), mail).alias("cells"), F.when(k % 101 == 0, "torn").alias("error"))
    return csv_files.review_groups(docs, 1).select("path", "kind", "first", "row_id")


QUERIES = {
    "triage": _triage,
    "undo_revisions": _undo,
    "cleanup_groups": _groups,
    "inbound_requests": _inbound,
    "pool_assignments": _pools,
    "intake_decisions": lambda s, d: _intake(s, d, False),
    "intake_decisions_with_contacts": lambda s, d: _intake(s, d, True),
    "canonical_records": _provider,
    "poll_page": lambda s, d: N.poll_page(_records(s, d), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), _now(), F.lit(40)).select("id"),
    "poll_windows": lambda s, d: N.poll_windows(_accounts(s, d), AS_OF),
    "linked_records": _linked,
    "webhook_hints": lambda s, d: N.webhook_hints(_webhooks(s, d)),
    "change_hints": lambda s, d: N.change_hints(_changes(s, d)),
    "queue_due": lambda s, d: N.due(_queue(s, d), _now(), 40).select("id"),
    "queue_after_failures": lambda s, d: N.after_failures(_queue(s, d), _queue(s, d).where("id % 2 = 0").select("id"), _now()),
    "queue_status": lambda s, d: N.queue_status(_queue(s, d)),
    "queue_retained": lambda s, d: N.retained(_queue(s, d), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"), 30, 50).select("id"),
    "recent_events": _recent,
    "native_reversals": lambda s, d: N.native_reversals(_native(s, d)),
    "notice_intents": _findings,
    "repair_budget": _budget,
    "incident_policies": _policies,
    "new_uploads": _uploads,
}
_c = "c AS (SELECT c_custkey k, CAST(c_custkey AS VARCHAR) t FROM customer)"
_pick = lambda items, n: "([" + ", ".join(f"'{x}'" for x in items) + f"])[{n} % {len(items)} + 1]"
_full = "(k % 6 = 0 OR k % 5 = 0 OR k * 97 % 100000 >= 86400 OR k % 4 = 0 OR k >= 10000)"
_INBOUND = f"""WITH {_WORLD}, a AS (SELECT w.*, CASE WHEN dm < 40 THEN dm END acc, CASE WHEN k % 13 <> 0 AND w.co < 40 THEN w.co END named, lead.t IS NOT NULL AND dm = w.co hl, lead.acc lacc, lead.own lown FROM w LEFT JOIN lead USING (t)),
b AS (SELECT *, coalesce(CASE WHEN hl THEN lown END, CASE WHEN acc % 6 = 0 THEN 'r' || (acc % 5) END) own, coalesce(CASE WHEN acc % 2 = 0 THEN 'East' END, CASE WHEN k % 3 = 0 THEN '' ELSE 'West' END) place, coalesce(CASE WHEN acc % 5 <> 0 THEN acc * 1000 END, CASE WHEN k % 11 = 0 THEN -1 ELSE k * 100 END) money FROM a),
c AS (SELECT *, CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN 'invalid' WHEN named IS NOT NULL AND named IS DISTINCT FROM acc THEN 'account_conflict' WHEN hl AND lacc IS DISTINCT FROM acc THEN 'other_account' WHEN own = 'r3' THEN 'owner_away' WHEN own IS NULL AND place = '' THEN 'no_region' WHEN own IS NULL AND money < 0 THEN 'no_budget' END reason FROM b)
SELECT t request_id, CASE WHEN reason IS NOT NULL THEN 'held' WHEN own IS NULL THEN 'pool' ELSE 'owned' END status, reason, CASE WHEN reason IS NULL AND hl THEN 'l' || t END lead_id, CASE WHEN reason IS NULL THEN acc END account_id, CASE WHEN reason IS NULL THEN own END owner_id, CASE WHEN reason IS NULL AND own IS NULL THEN place END region, CASE WHEN reason IS NULL AND own IS NULL THEN CASE WHEN money >= 35000 THEN 'Enterprise' ELSE 'Growth' END END segment FROM c"""
ORACLES = {
    "triage": f"""WITH {_c}, x AS (SELECT *, k % 2 = 0 p, k % 2 = 0 AND k % 8 % 5 = k % 4 hit FROM c) SELECT k id, k % 4 + CASE WHEN hit THEN 1 ELSE 0 END AS version, CASE WHEN hit AND k % 6 <> 0 THEN 'acknowledged' WHEN k % 3 = 0 THEN 'open' ELSE 'resolved' END status, CASE WHEN hit AND k % 10 = 0 THEN 'bo' WHEN k % 5 = 0 THEN 'ada' END assignee, CASE WHEN hit THEN 'applied' WHEN p THEN 'conflict' END outcome FROM x""",
    "undo_revisions": "SELECT o_custkey id, max(o_orderkey) + 1 revision, max(CASE WHEN r = 2 THEN o_orderstatus END) restored FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) r FROM orders) WHERE r <= 2 GROUP BY 1",
    "cleanup_groups": f"""WITH {_c}, r AS (SELECT 'f' || (k % 7) path, k, (k % 40) || '|' || CASE WHEN k % 31 = 0 THEN '' WHEN k % 2 = 0 THEN 'A' || (k % 20) ELSE 'a' || (k % 20) END w, CASE WHEN k % 31 <> 0 THEN k % 20 END e FROM c WHERE k % 101 <> 0),
g AS (SELECT path, k, 'row' kind, w key, w FROM r UNION ALL SELECT path, k, 'email', CAST(e AS VARCHAR), w FROM r WHERE e IS NOT NULL), n AS (SELECT path, kind, key, min(k) AS "first" FROM g GROUP BY 1, 2, 3 HAVING (kind = 'row' AND count(*) > 1) OR (kind = 'email' AND count(DISTINCT w) > 1))
SELECT g.path, g.kind, n."first", g.k row_id FROM g JOIN n ON g.path = n.path AND g.kind = n.kind AND g.key = n.key""",
    "inbound_requests": _INBOUND,
    "pool_assignments": f"""WITH i AS ({_INBOUND}), q AS (SELECT request_id, region, segment, row_number() OVER (PARTITION BY region, segment ORDER BY CAST(request_id AS BIGINT)) slot FROM i WHERE status = 'pool'),
r AS (SELECT 's' || c_custkey rep_id, CASE c_custkey % 3 WHEN 0 THEN 'East' WHEN 1 THEN 'West' END region, CASE WHEN c_custkey % 2 = 0 THEN 'Enterprise' ELSE 'Growth' END segment, c_custkey % 11 + c_custkey % 4 capacity, c_custkey % 5 assigned FROM customer WHERE c_custkey < 60 AND c_custkey % 7 <> 0),
f AS (SELECT *, unnest(range(assigned, capacity)) taken FROM r), o AS (SELECT region, segment, rep_id, row_number() OVER (PARTITION BY region, segment ORDER BY taken / CAST(capacity AS DOUBLE), rep_id) slot FROM f)
SELECT request_id, rep_id, CASE WHEN rep_id IS NULL THEN 'held' ELSE 'routed' END status FROM q LEFT JOIN o USING (region, segment, slot)""",
    "intake_decisions": _intake_sql(False),
    "intake_decisions_with_contacts": _intake_sql(True),
    "canonical_records": f"WITH {_c} SELECT 'crm:' || CASE WHEN k % 4 = 0 THEN 'lead' ELSE 'contact' END || ':' || t record_key, CASE WHEN k % 3 = 0 THEN 'Smith' ELSE 'Ada Smith' END full_name, CASE WHEN k % 5 = 0 THEN 'a@x.com|b@x.com' ELSE '' END additional_emails, CASE WHEN k % 2 <> 0 THEN t WHEN k % 7 <> 0 THEN '9' || t ELSE '' END phone, CASE WHEN k % 2 <> 0 AND k % 7 <> 0 THEN '9' || t ELSE '' END secondary_phone FROM c",
    "poll_page": "SELECT event_id id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-01' AND event_id > 40 ORDER BY event_id LIMIT 50",
    "poll_windows": f"WITH {_c} SELECT k account_id, CASE WHEN NOT {_full} THEN TIMESTAMP '2024-02-01' - to_seconds(k % 1000 + 300) END since, TIMESTAMP '2024-02-01' - to_seconds(120) until, {_full} \"full\" FROM c",
    "linked_records": f"""WITH {_c}, l AS (SELECT o_custkey k, list_sort(list(DISTINCT 'o' || (o_orderkey % 50))) ids FROM orders GROUP BY 1) SELECT k id, CASE WHEN k % 9 <> 0 THEN CASE WHEN ids IS NULL THEN '[]' ELSE '["' || array_to_string(ids, '","') || '"]' END END related FROM c LEFT JOIN l USING (k)""",
    "webhook_hints": f"""WITH {_c}, e AS (SELECT k, t, k % 8 s, {_pick(('COMPANY', 'CONTACT', 'TICKET', ''), 'k // 8')} target, k // 8 % 4 < 3 pair, k % 5 <> 0 hf FROM c),
a AS (SELECT *, pair AND hf f, k // 8 % 4 < 2 AS g FROM e WHERE s = 3)
SELECT k event_id, CASE s WHEN 0 THEN 'Contact' WHEN 1 THEN 'Company' ELSE 'Deal' END object_type, t record_id, CASE WHEN s = 2 THEN 'delete' ELSE 'refresh' END kind FROM e WHERE s < 3 AND k % 11 <> 0
UNION ALL SELECT k, 'Contact', t, 'refresh' FROM a WHERE f
UNION ALL SELECT k, CASE WHEN target = 'COMPANY' THEN 'Company' ELSE 'Contact' END, CASE WHEN k % 3 = 0 THEN t ELSE 'z' || t END, 'refresh' FROM a WHERE g AND NOT (f AND target = 'CONTACT' AND k % 3 = 0)
UNION ALL SELECT k, 'Contact', NULL, 'gap' FROM a WHERE NOT (f AND g) OR k % 7 = 0
UNION ALL SELECT k, 'Company', CASE WHEN k % 6 = 0 THEN 'n' || t ELSE 'p' || t END, 'refresh' FROM e WHERE s = 4 AND (k % 6 = 0 OR k % 2 = 0)
UNION ALL SELECT k, 'Company', NULL, 'gap' FROM e WHERE s = 4""",
    "change_hints": f"""WITH {_c}, e AS (SELECT k, t, {_pick(('Lead', 'Contact', 'Account'), 'k')} o, k % 5 y, k % 5 = 4 OR k % 13 = 0 gap FROM c)
SELECT k event_id, o object_type, NULL record_id, 'gap' kind FROM e WHERE gap UNION ALL SELECT k, o, unnest([t, t || 'b']), CASE WHEN y = 2 THEN 'delete' ELSE 'refresh' END FROM e WHERE NOT gap""",
    "queue_due": f"WITH {_QUEUE} SELECT id FROM q WHERE processed_at IS NULL AND NOT held AND next_attempt_at IS NULL ORDER BY received_at, id LIMIT 40",
    "queue_after_failures": f"WITH {_QUEUE} SELECT id, account_id, received_at, processed_at, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN attempts >= 2 ELSE held END held, attempts + CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 1 ELSE 0 END attempts, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN TIMESTAMP '2024-02-01 00:01:00' ELSE next_attempt_at END next_attempt_at FROM q",
    "queue_status": f"WITH {_QUEUE} SELECT account_id, count(*) pending, count(*) FILTER (WHERE held) held, min(received_at) oldest FROM q WHERE processed_at IS NULL GROUP BY 1",
    "queue_retained": f"WITH {_QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id, processed_at IS NULL ORDER BY received_at DESC, id DESC) n FROM q) SELECT id FROM r WHERE processed_at IS NULL OR (received_at >= TIMESTAMP '2024-01-11' AND n <= 50)",
    "recent_events": "SELECT o_orderkey id, 'c' || o_custkey record_key FROM orders WHERE (o_custkey % 40 = 0 OR (o_orderkey % 2 = 0 AND (o_custkey + 1) % 40 = 0 AND o_custkey + 1 IN (SELECT c_custkey FROM customer))) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "native_reversals": """WITH a AS (SELECT user_id record_id, date_trunc('hour', ts) "at", max(event_id % 3) v, count(DISTINCT event_id % 3) > 1 OR bool_or(event_id % 97 = 0) broken FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(CAST(broken AS INTEGER)) OVER (PARTITION BY record_id ORDER BY "at") run FROM a), l AS (SELECT *, lag(v) OVER (PARTITION BY record_id, run ORDER BY "at") prev FROM r WHERE NOT broken),
s AS (SELECT * FROM l WHERE prev IS DISTINCT FROM v), n AS (SELECT x.record_id, x.run, x."at", count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s z WHERE z.record_id = y.record_id AND z.run = y.run AND z.v = y.v AND z."at" < y."at")) returns FROM s x JOIN s y ON x.record_id = y.record_id AND x.run = y.run AND y."at" <= x."at" GROUP BY 1, 2, 3)
SELECT record_id, 'owner' field, arg_max(returns, "at") returns, max("at") last_at FROM n WHERE returns >= 3 GROUP BY 1""",
    "notice_intents": f"WITH {_c}, x AS (SELECT k, CASE WHEN k % 10 <> 0 THEN {_pick(('open', 'resolved', 'acknowledged'), 'k')} END s0, CASE WHEN k % 10 <> 0 THEN k % 4 END o0, {_pick(('open', 'resolved', 'acknowledged'), 'k // 2')} s1, k % 4 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END o1 FROM c) SELECT 'finding:' || k || ':' || o1 || ':' || s1 AS key, s1 status FROM x WHERE s1 <> 'acknowledged' AND NOT (s0 IS NOT DISTINCT FROM s1 AND o0 IS NOT DISTINCT FROM o1)",
    "repair_budget": "WITH l AS (SELECT user_id % 3 account_id, user_id % 40 record_id, floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(ts)) age FROM events), w AS (SELECT * FROM l WHERE age BETWEEN 0 AND 86400), h AS (SELECT account_id, count(*) FILTER (WHERE age <= 3600) hourly FROM w GROUP BY 1) SELECT account_id, record_id, hourly, count(*) daily, CASE WHEN count(*) >= 9 THEN 'record_daily' WHEN hourly >= 12 THEN 'account_hourly' END reason FROM w JOIN h USING (account_id) GROUP BY 1, 2, 3",
    "incident_policies": f"WITH {_c}, a AS (SELECT k FROM c WHERE k < 18) SELECT c.k incident_id, CASE WHEN a.k IS NULL THEN NULL WHEN c.k % 5 IN (1, 3) THEN (c.k % 20) || 'v' || (c.k % 5) ELSE 'now' || (c.k % 20) END policy FROM c LEFT JOIN a ON a.k = c.k % 20",
    "new_uploads": f"WITH {_c} SELECT k % 2 provider, sha256(CAST(k % 30 AS VARCHAR)) digest, min('f' || t) path FROM c WHERE k % 30 >= 10 OR (SELECT count(*) FROM c x WHERE x.k < 10 AND x.k = c.k % 30 AND x.k % 2 = c.k % 2) = 0 GROUP BY 1, 2",
}
