"""Registered routing, incident, state and text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import incidents as N
from tidemark.operators import routing as R
from tidemark.operators import state as S
from tidemark.sources import csv_files
from tidemark.sources.views import CONTACTS_SQL, CRM_EVENTS_SQL, contacts, crm_events, table


def _leads(s, d):
    k = F.col("c_custkey")
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (n + 1).cast("int"))
    return table(s, d, "customer").select(k.cast("string").alias("lead_id"), ((k * 7919) % 30_000_000).alias("revenue"), (k % 900).alias("employees"), (k % 2).alias("intent"), pick(("West", "Central", "Southeast", "Northeast"), k % 4).alias("region"), F.concat(F.lit("p"), k.cast("string"), F.when(k % 9 == 0, F.lit("@x")).otherwise(F.lit("@x.com"))).alias("email"), F.when(k % 8 == 0, "").otherwise("Acme").alias("company"), F.when(k % 6 == 0, "").otherwise("Smith").alias("last_name"), F.when(k % 2 == 0, "").otherwise("555").alias("phone"), F.when(k % 3 == 0, "").otherwise("x.com").alias("website"))


_LEADS = """l AS (SELECT CAST(c_custkey AS VARCHAR) lead_id, c_custkey k, (c_custkey * 7919) % 30000000 revenue, c_custkey % 900 employees, c_custkey % 2 intent, (['West','Central','Southeast','Northeast'])[c_custkey % 4 + 1] region FROM customer),
sc AS (SELECT lead_id, k, least(100, CAST(floor(revenue / 500000.0::DOUBLE + employees / 20.0::DOUBLE + 25 * intent + 0.5) AS BIGINT)) score, CASE WHEN revenue >= 20000000 THEN 'Enterprise' WHEN revenue >= 5000000 THEN 'Mid-Market' ELSE 'SMB' END segment, region FROM l)"""


def _policies(s):
    rows = [("Enterprise high", 10, 75, "ENTERPRISE", "q-ent"), ("High", 20, 75, "", "q-high"), ("Ready", 100, 60, "", "q-ready")]
    return s.createDataFrame(rows, "name string, priority int, min_score int, segment string, queue string")


def _observations(s, d):
    """Owner per user over time; blank when the event id is divisible by 3."""
    e = table(s, d, "events")
    value = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("o"), (F.col("event_id") % 2).cast("string")))
    return e.select(F.col("user_id").cast("string").alias("record_id"), F.lit("owner").alias("field"), value.alias("value"), F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("at"))


_OBS = """o AS (SELECT CAST(user_id AS VARCHAR) record_id, 'owner' field, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'o' || (event_id % 2) END AS value, date_trunc('minute', ts) AS "at" FROM events),
one AS (SELECT record_id, field, "at", max(value) AS after, count(DISTINCT coalesce(value, chr(0))) > 1 ambiguous FROM o GROUP BY 1, 2, 3),
seen AS (SELECT *, lag(after) OVER w AS before, row_number() OVER w n FROM one WHERE NOT ambiguous WINDOW w AS (PARTITION BY record_id, field ORDER BY "at")),
ch AS (SELECT record_id, field, before, after, "at" FROM seen WHERE n > 1 AND before IS DISTINCT FROM after)"""


def _clears(s, d):
    population = table(s, d, "events").agg(F.countDistinct("user_id").alias("records")).select(F.lit("owner").alias("field"), "records")
    return N.bulk_clears(N.changes(_observations(s, d)), population, least=3, share=0.01)


def _stages(s, d):
    return crm_events(s, d).select(F.col("lead_id").alias("record_id"), F.col("lifecycle_stage").alias("value"), F.col("event_timestamp").alias("at"))


def _plan(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    mail = F.when(k % 10 == 9, "").otherwise(F.concat(F.lit("m"), (k - F.when(k % 7 == 6, 1).otherwise(0)).cast("string"), F.lit("@x.com")))
    inputs = c.select(k.cast("string").alias("contact_id"), mail.alias("email"), F.when(k % 4 == 0, "").otherwise("Acme").alias("company"), F.concat(F.lit("5"), k.cast("string")).alias("phone"))
    existing = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("n"), k.cast("string")).alias("native_id"), F.concat(F.lit("M"), k.cast("string"), F.lit("@x.com")).alias("email"), F.when(k % 5 == 0, "").when(k % 5 == 1, "Other").otherwise("Acme").alias("company"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("5"), k.cast("string"))).alias("phone"))
    return S.write_plan(inputs, existing, ("company", "phone"))


def _verify(s, d):
    o = table(s, d, "orders")
    expected = o.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    actual = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return S.verify_run(expected, actual, ("status", "priority")).select("record_id", F.col("status").alias("outcome"), "fields")


def _texts(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    a, b = F.lower("c_name"), F.concat(F.lit("customer#"), F.lpad((k * 3).cast("string"), 9, "0"))
    return c.select(k.alias("id"), T.fnv1a(a).alias("fnv"), F.round(T.dice(a, b), 6).alias("dice"), T.header(F.concat(F.lit(" A-"), F.col("c_name"), F.lit(" "))).alias("header"), T.company_key(F.col("c_name")).alias("company_key"), T.formula_guard(F.concat(F.when(k % 2 == 0, "=").otherwise(""), F.col("c_name"))).alias("guarded"))


QUERIES = {
    "lead_scores": lambda s, d: R.scored_leads(_leads(s, d)).select("lead_id", "score", "segment", "owner", "stage"),
    "lead_triage": lambda s, d: R.triage(_leads(s, d)).select("lead_id", "readiness", "ready"),
    "policy_routes": lambda s, d: R.policy_routes(R.scored_leads(_leads(s, d)), _policies(s)),
    "account_matches": lambda s, d: R.match_accounts(table(s, d, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("Nation "), (F.col("c_custkey") % 30).cast("string")).alias("company"), F.concat(F.lit("a@n"), (F.col("c_nationkey")).cast("string"), F.lit(".com")).alias("email")), table(s, d, "nation").select(F.col("n_nationkey").alias("account_id"), F.concat(F.lit(" nation  "), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".com")).alias("domain"))),
    "field_changes": lambda s, d: N.changes(_observations(s, d)),
    "bulk_clears": _clears,
    "ambiguous_values": lambda s, d: N.ambiguous(_observations(s, d)),
    "reversals": lambda s, d: N.reversals(N.changes(_observations(s, d))),
    "activity_drop": lambda s, d: N.activity_drop(table(s, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("record_id"), F.col("ts").alias("at")), "2024-02-01 00:00:00"),
    "broken_links": lambda s, d: N.broken_links(table(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("target_id")), table(s, d, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("id"))),
    "stage_high_water": lambda s, d: N.high_water(_stages(s, d)).groupBy("record_id").agg(F.count_if("regressed").alias("regressions"), F.max("high").alias("high")),
    "upsert_newest": lambda s, d: S.upsert_newest(_orders(s, d).where("o_orderkey % 2 = 0"), _orders(s, d), "o_custkey", "o_orderdate"),
    "retained_newest": lambda s, d: S.newest(_orders(s, d), "o_custkey", "o_orderdate", 3, "o_orderkey"),
    "receipt_counts": lambda s, d: S.combined_receipts(table(s, d, "orders").select(F.col("o_custkey").alias("contact_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))),
    "write_plan": _plan,
    "run_verification": _verify,
    "work_queue": lambda s, d: S.work_queue({"order": table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"), F.col("o_orderdate").alias("updated_at")), "event": table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("open").alias("status"), F.col("ts").alias("updated_at"))}),
    "text_functions": _texts,
    "contact_csv": lambda s, d: csv_files.csv_lines(contacts(s, d), ("contact_id", "full_name", "raw_email", "company", "owner_id")),
}


def _orders(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")


_act = "count(DISTINCT CASE WHEN epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) >= {} AND epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) < {} THEN user_id END)"
_big = lambda x: f"list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2))"
ORACLES = {
    "contact_csv": f"WITH {CONTACTS_SQL} SELECT contact_id || ',' || full_name || ',' || raw_email || ',' || company || ',' || owner_id line, 0 guarded FROM contacts",
    "text_functions": f"""WITH n AS (SELECT c_custkey id, c_name, lower(c_name) a, 'customer#' || lpad(CAST(c_custkey * 3 AS VARCHAR), 9, '0') b FROM customer), g AS (SELECT *, {_big('a')} x, {_big('b')} y FROM n)
SELECT id, printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(a, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) fnv,
 round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) / (len(x) + len(y)) END, 6) dice,
 'a_' || replace(a, '#', '_') AS header, replace(a, '#', '') company_key, CASE WHEN id % 2 = 0 THEN '''=' ELSE '' END || c_name guarded FROM g""",
    "stage_high_water": f"""WITH {CRM_EVENTS_SQL}, r AS (SELECT lead_id record_id, lifecycle_stage v, event_timestamp t, nullif(list_position(['lead','mql','sql','opportunity','closed_won'], lifecycle_stage), 0) rank FROM crm_events),
u AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY t, v) run FROM r), h AS (SELECT *, max(rank) OVER (PARTITION BY record_id, run ORDER BY t, v ROWS UNBOUNDED PRECEDING) high FROM u)
SELECT record_id, count(*) FILTER (WHERE rank < high) regressions, CAST(max(CASE WHEN rank IS NOT NULL THEN high END) AS INTEGER) high FROM h GROUP BY 1""",
    "work_queue": """WITH o AS (SELECT 'order' kind, CAST(o_orderkey AS VARCHAR) id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'failed' END status, CAST(o_orderdate AS TIMESTAMP) updated_at FROM orders ORDER BY updated_at DESC, id LIMIT 100), e AS (SELECT 'event' kind, CAST(event_id AS VARCHAR) id, 'open' status, ts updated_at FROM events ORDER BY updated_at DESC, id LIMIT 100)
SELECT kind, id, status, updated_at, CASE status WHEN 'done' THEN 'done' WHEN 'failed' THEN 'needs_attention' ELSE 'open' END state FROM (SELECT * FROM o UNION ALL SELECT * FROM e) ORDER BY updated_at DESC, kind, id LIMIT 100""",
    "lead_scores": f"WITH {_LEADS} SELECT lead_id, score, segment, upper(region[1:2]) || '-' || CASE segment WHEN 'Enterprise' THEN 'ENT' WHEN 'Mid-Market' THEN 'MM' ELSE 'SMB' END AS owner, CASE WHEN score >= 70 THEN 'mql' ELSE 'lead' END stage FROM sc",
    "lead_triage": "SELECT *, readiness >= 75 ready FROM (SELECT CAST(c_custkey AS VARCHAR) lead_id, 25 * CAST(c_custkey % 9 <> 0 AS INTEGER) + 25 * CAST(c_custkey % 8 <> 0 AS INTEGER) + 25 * CAST(c_custkey % 6 <> 0 AS INTEGER) + 15 * CAST(c_custkey % 2 <> 0 AS INTEGER) + 10 * CAST(c_custkey % 3 <> 0 AS INTEGER) readiness FROM customer)",
    "policy_routes": f"WITH {_LEADS}, pol(policy, priority, least, seg, queue) AS (VALUES ('Enterprise high', 10, 75, 'enterprise', 'q-ent'), ('High', 20, 75, '', 'q-high'), ('Ready', 100, 60, '', 'q-ready')), j AS (SELECT lead_id, policy, queue, row_number() OVER (PARTITION BY lead_id ORDER BY priority, policy) r FROM sc LEFT JOIN pol ON score >= least AND (seg = '' OR seg = lower(segment))) SELECT lead_id, policy, queue, CASE WHEN policy IS NULL THEN 'no_policy' ELSE 'routed' END status FROM j WHERE r = 1",
    "account_matches": """WITH r AS (SELECT c_custkey request_id, c_custkey % 30 n, c_nationkey d FROM customer), h AS (SELECT request_id, n_nationkey account_id, max(CAST(n_nationkey = n AS INTEGER)) bn, max(CAST(n_nationkey = d AS INTEGER)) bd FROM r JOIN nation ON n_nationkey = n OR n_nationkey = d GROUP BY 1, 2),
p AS (SELECT request_id, count(*) hits, count(*) FILTER (WHERE bn = 1 AND bd = 1) whole, min(CASE WHEN bn = 1 AND bd = 1 THEN account_id END) a FROM h GROUP BY 1)
SELECT request_id, CASE WHEN hits IS NULL THEN 'new' WHEN whole = 1 AND hits = 1 THEN 'matched' ELSE 'conflict' END status, CASE WHEN whole = 1 AND hits = 1 THEN a END account_id FROM r LEFT JOIN p USING (request_id)""",
    "field_changes": f"WITH {_OBS} SELECT * FROM ch",
    "bulk_clears": f'''WITH {_OBS}, c AS (SELECT * FROM ch WHERE after = '' AND before <> ''), t AS (SELECT DISTINCT field, "at" FROM c), w AS (SELECT t.field, t."at", count(DISTINCT c.record_id) records FROM t JOIN c ON c.field = t.field AND c."at" <= t."at" AND c."at" >= t."at" - INTERVAL 30 MINUTE GROUP BY 1, 2)
SELECT field, "at", records, round(records / CAST((SELECT count(DISTINCT user_id) FROM events) AS DOUBLE), 6) share FROM w WHERE records >= 3 AND records / CAST((SELECT count(DISTINCT user_id) FROM events) AS DOUBLE) >= 0.01''',
    "ambiguous_values": f'WITH {_OBS} SELECT record_id, field, "at" FROM one WHERE ambiguous',
    "reversals": f'''WITH {_OBS}, c AS (SELECT a.record_id, a.field, a."at", count(*) n FROM ch a JOIN ch b ON a.record_id = b.record_id AND a.field = b.field AND b."at" <= a."at" AND epoch(a."at") - epoch(b."at") <= 86400 AND b.before IS NOT DISTINCT FROM a.after AND b.after IS NOT DISTINCT FROM a.before GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT record_id, field, CAST(max(n) AS BIGINT) reversals, min("at") first_at FROM c GROUP BY 1, 2''',
    "activity_drop": f"SELECT event_type kind, {_act.format(0, 86400)} recent, {_act.format(86400, 172800)} previous FROM events GROUP BY 1 HAVING recent = 0 AND previous >= 10",
    "broken_links": "SELECT o_orderkey record_id, o_custkey target_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 50 <> 0)",
    "upsert_newest": "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderstatus DESC) r FROM orders) WHERE r = 1",
    "retained_newest": "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) r FROM orders) WHERE r <= 3",
    "receipt_counts": "SELECT status, count(*) n FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) status FROM orders GROUP BY 1) GROUP BY 1",
    "run_verification": "SELECT o_orderkey record_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'different' ELSE 'verified' END outcome, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 'status' ELSE '' END fields FROM orders",
    "write_plan": """WITH i AS (SELECT CAST(c_custkey AS VARCHAR) contact_id, c_custkey k, c_custkey - CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 0 END t FROM customer),
j AS (SELECT *, k % 10 = 9 AS none, k % 10 <> 9 AND t % 3 <> 0 AND t IN (SELECT c_custkey FROM customer) hit FROM i), w AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY t) claims FROM j),
x AS (SELECT *, CASE WHEN k % 4 = 0 OR t % 5 IN (2,3,4) THEN NULL WHEN t % 5 = 0 THEN 'fill:company' ELSE 'review:company' END c1, CASE WHEN t % 2 = 0 THEN 'fill:phone' WHEN k = t THEN NULL ELSE 'review:phone' END c2 FROM w)
SELECT contact_id, CASE WHEN none THEN 'hold_no_email' WHEN NOT hit THEN 'create' WHEN claims > 1 THEN 'hold_shared_target' WHEN c1 IS NULL AND c2 IS NULL THEN 'unchanged' WHEN coalesce(c1, '') LIKE 'review%' OR coalesce(c2, '') LIKE 'review%' THEN 'review' ELSE 'update' END decision, CASE WHEN hit THEN 'n' || t END native_id, CASE WHEN hit THEN concat_ws('|', c1, c2) ELSE '' END changes FROM x""",
}
