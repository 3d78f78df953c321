"""Registered queries of incident state with their SQL: detectors over the observed events, chained into members, history and silences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coverage as C
from tidemark.operators import incident_state as I
from tidemark.operators import incidents as N
from tidemark.plans.ops_queries import _OBS, _observations, _stages
from tidemark.sources.views import CRM_EVENTS_SQL, table


def _detections(s: SparkSession, d: str) -> DataFrame:
    """Cleared owners, conflicting values and stage regressions, found in hourly passes; every fifth clear has lost its time, every seventh its record."""
    seen = _observations(s, d)
    k = F.col("record_id").cast("long")
    clears = N.changes(seen).where("after = '' AND before <> ''").select(F.lit("clear").alias("kind"), F.lit("Contact").alias("object_type"), "field", F.when(k % 7 != 0, F.col("record_id")).alias("record_id"), F.when(k % 5 != 0, F.col("at")).alias("at"))
    conflicts = N.ambiguous(seen).select(F.lit("coverage"), F.lit("Contact"), F.lit("timestamp_order"), "record_id", "at")
    back = N.high_water(_stages(s, d)).where("regressed").select(F.lit("regression"), F.lit("Lead"), F.lit(None).cast("string"), "record_id", F.col("at").cast("timestamp_ntz"))
    return clears.union(conflicts).union(back).withColumn("at", F.date_trunc("hour", "at").cast("timestamp_ntz"))


def _resolutions(s: SparkSession, d: str) -> DataFrame:
    """Each incident is resolved at noon of every third day that has a pass."""
    rows = I.fingerprinted(_detections(s, d)).where("dayofmonth(at) % 3 = 0")
    return rows.select("fingerprint", (F.date_trunc("day", "at").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("at")).distinct()


def _activity(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select((F.col("user_id") % 7).cast("string").alias("account_id"), F.col("user_id").cast("string").alias("record_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Customers as contacts, companies and accounts; relations that are lists, single ids, blank, broken or name what isn't there."""
    k = F.col("c_custkey")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=(k * 37 % 1000).cast("int"))
    t = lambda c: c.cast("string")
    companies = F.when(k % 5 == 0, F.lit("[broken")).when(k % 5 == 1, F.lit(" ")).otherwise(F.concat(F.lit('["'), t(k % 90), F.lit('","'), t(k % 60), F.lit('","'), t(k % 90), F.lit('"]')))
    properties = F.map_from_entries(F.array_compact(F.array(F.when(k % 3 == 0, F.struct(F.lit("company_id").alias("k"), t(k % 40).alias("v"))), F.struct(F.lit("company_ids").alias("k"), companies.alias("v")), F.when(k % 4 == 0, F.struct(F.lit("account_id").alias("k"), F.lit(None).cast("string").alias("v"))), F.struct(F.lit("contact_ids").alias("k"), t(k + 1).alias("v")))))
    rows = table(s, d, "customer").select(F.when(k % 6 == 0, "Company").when(k % 6 == 1, "Account").otherwise("Contact").alias("object_type"), t(k).alias("record_id"), at.alias("at"), properties.alias("properties"))
    return rows


def _members(s: SparkSession, d: str) -> DataFrame:
    """Three incidents of every record, of every fourth, and of a few."""
    k = F.col("c_custkey")
    each = F.array_compact(F.array(F.lit("clear:Contact:email"), F.when(k % 4 == 0, "coverage:all:fields"), F.when(k < 9, "few")))
    return table(s, d, "customer").select(F.explode(each).alias("fingerprint"), k.cast("string").alias("record_id"))


AS_OF = "1995-06-01"
RULES = [("owner", "Deal", "stage", ["F", "P"], "owner", 60 * 24 * 30), ("note", "Deal", "stage", ["F"], "note", 60 * 24 * 200), ("phone", "Contact", "tier", ["1-URGENT", "2-HIGH", None], "phone", 60 * 24 * 365), ("never", "Contact", "tier", [], "phone", 1)]


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Orders as observed records: fields that are absent, blank, null or spaces; observations of one time that disagree; every 23rd could not be read whole."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    deal = c % 2 == 0
    field = lambda there, name, value: F.when(there, F.struct(F.lit(name).alias("k"), value.alias("v")))
    blank = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("é"), k.cast("string")))
    fields = F.array_compact(F.array(field(deal & (k % 13 != 0), "stage", F.col("o_orderstatus")), field(deal & (k % 17 != 0), "owner", blank), field(deal, "note", F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("n"))), field(~deal & (k % 11 != 0), "tier", F.col("o_orderpriority")), field(~deal & (k % 19 != 0), "phone", blank)))
    return table(s, d, "orders").select((c % 7).cast("string").alias("account_id"), F.when(deal, "Deal").otherwise("Contact").alias("object_type"), (c % 500).cast("string").alias("record_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.map_from_entries(fields).alias("properties"), F.when(k % 2300 == 0, F.array(F.lit("links"))).alias("coverage"))


def _rules(s: SparkSession) -> DataFrame:
    return s.createDataFrame(RULES, "rule_id string, object_type string, when_field string, when_values array<string>, required_field string, deadline_minutes long")


def _checks(s: SparkSession, d: str) -> DataFrame:
    """Checks of seven accounts: one stale, one degraded, one in its baseline."""
    o = table(s, d, "orders").where("o_custkey % 7 < 6 AND o_orderdate < DATE '1995-06-01'")
    a = F.col("o_custkey") % 7
    at = F.expr("TIMESTAMP_NTZ '1995-05-31 23:50:00'") - F.make_dt_interval(mins=(F.col("o_orderkey") % 30 + F.when(a == 1, 60).otherwise(0)).cast("int"))
    return o.select(a.cast("string").alias("account_id"), at.alias("at"), F.when(a == 2, "degraded").otherwise("healthy").alias("status"), F.when(a == 3, "baseline").otherwise("changes").alias("phase"), F.when(a == 4, F.lit(None).cast("long")).otherwise(F.lit(3000).cast("long")).alias("stale_after_seconds"))


def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    return C.coverage(_checks(s, d), _snapshots(s, d).where(F.col("at") <= _as_of()), _as_of())


def _clocks(s: SparkSession, d: str) -> DataFrame:
    plans = s.createDataFrame([("Contact", "phone", "1995-07-01"), ("Deal", "owner", "1995-05-01")], "object_type string, field string, until string").withColumn("until", F.col("until").cast("timestamp_ntz"))
    return C.clocks(_snapshots(s, d).where(F.col("at") <= _as_of()), _rules(s), plans, _coverage(s, d), _as_of())


def _unique(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of which no record has two at one time."""
    rows = _snapshots(s, d)
    alone = rows.groupBy("account_id", "object_type", "record_id", "at").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return rows.join(alone, ["account_id", "object_type", "record_id", "at"], "left_semi")


def _retained(s: SparkSession, d: str) -> DataFrame:
    policies = s.createDataFrame([("0", 400, 50), ("1", 30, 10_000_000), ("2", 0, 5), ("3", 4000, 0)], "account_id string, retention_days long, most long")
    rows = _snapshots(s, d).where(F.col("at") <= _as_of()).select("account_id", "record_id", "at").distinct()
    return C.retained(rows, policies, _as_of())


QUERIES = {
    "coverage_status": _coverage,
    "expectation_clocks": _clocks,
    "expectation_unknowns": lambda s, d: C.unevaluable(_unique(s, d), _rules(s)),
    "observations_retained": _retained,
    "incident_related": lambda s, d: I.related(_members(s, d), _records(s, d)),
    "incident_members": lambda s, d: I.members(_detections(s, d)),
    "incident_history": lambda s, d: I.history(_detections(s, d), _resolutions(s, d)),
    "incident_silences": lambda s, d: I.silences(_activity(s, d), 120, F.lit("2024-02-15").cast("timestamp_ntz"), 2),
}

_DETECTIONS = f"""{_OBS}, {CRM_EVENTS_SQL}, hw AS (SELECT lead_id, lifecycle_stage v, event_timestamp t, nullif(list_position(['lead','mql','sql','opportunity','closed_won'], lifecycle_stage), 0) rank FROM crm_events),
hr AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY lead_id ORDER BY t, v) run FROM hw), hh AS (SELECT *, max(rank) OVER (PARTITION BY lead_id, run ORDER BY t, v ROWS UNBOUNDED PRECEDING) high FROM hr),
det AS (SELECT fingerprint, record_id, date_trunc('hour', t) t FROM (
 SELECT 'clear:Contact:' || field fingerprint, CASE WHEN CAST(record_id AS BIGINT) % 7 <> 0 THEN record_id END record_id, CASE WHEN CAST(record_id AS BIGINT) % 5 <> 0 THEN "at" END t FROM ch WHERE after = '' AND before <> ''
 UNION ALL SELECT 'coverage:Contact:timestamp_order', record_id, "at" FROM one WHERE ambiguous
 UNION ALL SELECT 'regression:Lead', lead_id, t FROM hh WHERE rank < high) WHERE t IS NOT NULL)"""
_blank = "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'é' || o_orderkey END"
_SNAP = f"""ob AS (SELECT CAST(o_custkey % 7 AS VARCHAR) account_id, CASE WHEN o_custkey % 2 = 0 THEN 'Deal' ELSE 'Contact' END object_type, CAST(o_custkey % 500 AS VARCHAR) record_id, CAST(o_orderdate AS TIMESTAMP) t,
 o_custkey % 2 = 0 AND o_orderkey % 13 <> 0 has_stage, o_orderstatus stage, o_custkey % 2 = 0 AND o_orderkey % 17 <> 0 has_owner, {_blank} filled, o_custkey % 2 = 0 has_note, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'n' END note,
 o_custkey % 2 = 1 AND o_orderkey % 11 <> 0 has_tier, o_orderpriority tier, o_custkey % 2 = 1 AND o_orderkey % 19 <> 0 has_phone, o_orderkey % 2300 = 0 gap FROM orders)"""
_JUDGED = f"""{_SNAP}, ju AS (SELECT account_id, object_type, record_id, t, 'owner' rule_id, 30 AS n_days, CASE WHEN NOT has_stage THEN 'stage' WHEN stage IN ('F', 'P') AND NOT has_owner THEN 'owner' END missing, stage IN ('F', 'P') AND trim(filled) = '' unmet FROM ob WHERE object_type = 'Deal'
 UNION ALL SELECT account_id, object_type, record_id, t, 'note', 200, CASE WHEN NOT has_stage THEN 'stage' END, stage = 'F' AND note = '' FROM ob WHERE object_type = 'Deal'
 UNION ALL SELECT account_id, object_type, record_id, t, 'phone', 365, CASE WHEN NOT has_tier THEN 'tier' WHEN tier IN ('1-URGENT', '2-HIGH') AND NOT has_phone THEN 'phone' END, tier IN ('1-URGENT', '2-HIGH') AND trim(filled) = '' FROM ob WHERE object_type = 'Contact'
 UNION ALL SELECT account_id, object_type, record_id, t, 'never', 0, CASE WHEN NOT has_tier THEN 'tier' END, FALSE FROM ob WHERE object_type = 'Contact')"""
_COVERAGE = f"""ck AS (SELECT CAST(a AS VARCHAR) account_id, TIMESTAMP '1995-05-31 23:50:00' - to_minutes(o_orderkey % 30 + CASE WHEN a = 1 THEN 60 ELSE 0 END) t, CASE WHEN a = 2 THEN 'degraded' ELSE 'healthy' END st, CASE WHEN a = 3 THEN 'baseline' ELSE 'changes' END phase, CASE WHEN a = 4 THEN 900 ELSE 3000 END stale FROM (SELECT *, o_custkey % 7 a FROM orders WHERE o_custkey % 7 < 6 AND o_orderdate < DATE '1995-06-01')),
la AS (SELECT account_id, max(t) t, any_value(st) st, any_value(phase) phase, any_value(stale) stale FROM ck GROUP BY 1),
gp AS (SELECT account_id, count(*) FILTER (WHERE gap) gaps, count(*) records FROM (SELECT account_id, object_type, record_id, bool_or(gap) gap FROM (SELECT *, t = max(t) OVER (PARTITION BY account_id, object_type, record_id) newest FROM ob WHERE t <= TIMESTAMP '{AS_OF}') WHERE newest GROUP BY 1, 2, 3) GROUP BY 1),
cv AS (SELECT account_id, CASE WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(t) > stale THEN 'stale' WHEN st = 'degraded' OR coalesce(gaps, 0) > 0 THEN 'degraded' WHEN phase = 'baseline' THEN 'baseline' ELSE 'healthy' END status, phase, coalesce(gaps, 0) gaps, coalesce(records, 0) records, t last_checked_at FROM la LEFT JOIN gp USING (account_id))"""
ORACLES = {
    "incident_related": """WITH c AS (SELECT c_custkey k, CAST(c_custkey AS VARCHAR) t, CASE c_custkey % 6 WHEN 0 THEN 'Company' WHEN 1 THEN 'Account' ELSE 'Contact' END ot, TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 37 % 1000) a FROM customer),
m AS (SELECT 'clear:Contact:email' f, c.* FROM c UNION ALL SELECT 'coverage:all:fields', c.* FROM c WHERE k % 4 = 0 UNION ALL SELECT 'few', c.* FROM c WHERE k < 9),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY f ORDER BY a DESC, t) <= 50),
r AS (SELECT f, a, t, 0 fi, 0 nth, 'Company' ot, CAST(k % 40 AS VARCHAR) id FROM n WHERE k % 3 = 0 UNION ALL SELECT f, a, t, 1, 0, 'Company', CAST(k % 90 AS VARCHAR) FROM n WHERE k % 5 > 1 UNION ALL SELECT f, a, t, 1, 1, 'Company', CAST(k % 60 AS VARCHAR) FROM n WHERE k % 5 > 1 UNION ALL SELECT f, a, t, 3, 0, 'Contact', CAST(k + 1 AS VARCHAR) FROM n),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY f, ot, id ORDER BY a DESC, t, fi, nth) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY a DESC, t, fi, nth) place FROM u)
SELECT f fingerprint, CAST(place AS INTEGER) place, p.ot object_type, p.id record_id, c.a AS "at" FROM p JOIN c ON c.ot = p.ot AND c.t = p.id WHERE place <= 30""",
    "coverage_status": f"WITH {_SNAP}, {_COVERAGE} SELECT * FROM cv",
    "expectation_clocks": f"""WITH {_JUDGED}, {_COVERAGE}, u AS (SELECT account_id, object_type, record_id, rule_id, n_days, t, bool_or(unmet) unmet FROM ju WHERE missing IS NULL AND t <= TIMESTAMP '{AS_OF}' GROUP BY ALL HAVING bool_or(unmet) = bool_and(unmet)),
w AS (SELECT *, max(CASE WHEN NOT unmet THEN t END) OVER (PARTITION BY account_id, object_type, record_id, rule_id) met FROM u),
s AS (SELECT account_id, object_type, record_id, rule_id, min(t) since, min(t) + to_days(any_value(n_days)) due_at FROM w WHERE unmet AND (met IS NULL OR t > met) GROUP BY 1, 2, 3, 4)
SELECT s.account_id, object_type, record_id, rule_id, since, due_at, CASE WHEN due_at > TIMESTAMP '{AS_OF}' THEN 'waiting' WHEN cv.status IS DISTINCT FROM 'healthy' OR cv.phase <> 'changes' THEN 'gated' WHEN rule_id = 'phone' THEN 'planned' ELSE 'due' END state FROM s LEFT JOIN cv ON s.account_id = cv.account_id""",
    "expectation_unknowns": f"""WITH {_JUDGED}, o1 AS (SELECT *, count(*) OVER (PARTITION BY account_id, object_type, record_id, rule_id, t) n FROM ju), l AS (SELECT *, row_number() OVER (PARTITION BY account_id, object_type, record_id, rule_id ORDER BY t DESC) r FROM o1 WHERE n = 1)
SELECT account_id, object_type, record_id, rule_id, missing FROM l WHERE r = 1 AND missing IS NOT NULL""",
    "observations_retained": f"""WITH {_SNAP}, d AS (SELECT DISTINCT account_id, record_id, t FROM ob WHERE t <= TIMESTAMP '{AS_OF}'), p(a, days, most) AS (VALUES ('0', 400, 50), ('1', 30, 10000000), ('2', 0, 5), ('3', 4000, 0)),
k AS (SELECT d.*, most, row_number() OVER (PARTITION BY account_id ORDER BY t DESC, record_id DESC) r FROM d LEFT JOIN p ON a = account_id WHERE days IS NULL OR epoch(TIMESTAMP '{AS_OF}') - epoch(t) <= days * 86400)
SELECT account_id, record_id, t AS "at" FROM k WHERE most IS NULL OR r <= most""",
    "incident_members": f'WITH {_DETECTIONS} SELECT fingerprint, record_id, min(t) first_at, max(t) last_at, count(DISTINCT t) passes FROM det WHERE record_id IS NOT NULL GROUP BY 1, 2',
    "incident_history": f"""WITH {_DETECTIONS}, ends AS (SELECT DISTINCT fingerprint, date_trunc('day', t) + INTERVAL 12 HOUR t FROM det WHERE day(t) % 3 = 0),
ps AS (SELECT fingerprint, t, count(DISTINCT record_id) records FROM det GROUP BY 1, 2), fr AS (SELECT fingerprint, record_id, min(t) t FROM det WHERE record_id IS NOT NULL GROUP BY 1, 2),
st AS (SELECT fingerprint, t, 0 resolved, records, (SELECT count(*) FROM fr WHERE fr.fingerprint = ps.fingerprint AND fr.t = ps.t) joined FROM ps UNION ALL SELECT fingerprint, t, 1, 0, 0 FROM ends),
ru AS (SELECT *, CAST(sum(joined) OVER o AS BIGINT) members, CAST(sum(1 - resolved) OVER o AS BIGINT) AS version, lag(resolved) OVER (PARTITION BY fingerprint ORDER BY t, resolved) prev FROM st WINDOW o AS (PARTITION BY fingerprint ORDER BY t, resolved ROWS UNBOUNDED PRECEDING))
SELECT fingerprint, t AS "at", version, records, members, CASE WHEN version = 1 THEN 'detected' WHEN records > members - joined AND floor(log2(records / {N.LEAST_RECORDS}.0::DOUBLE)) > floor(log2(greatest({N.LEAST_RECORDS}, members - joined) / {N.LEAST_RECORDS}.0::DOUBLE)) THEN 'scope_expanded' WHEN prev = 1 THEN 'reopened' END AS event FROM ru WHERE resolved = 0""",
    "incident_silences": """WITH a AS (SELECT CAST(user_id % 7 AS VARCHAR) account_id, CAST(user_id AS VARCHAR) record_id, date_trunc('minute', ts) t FROM events),
n AS (SELECT account_id, t, lead(t) OVER (PARTITION BY account_id ORDER BY t) nt FROM (SELECT DISTINCT account_id, t FROM a)), q AS (SELECT account_id, t FROM n WHERE coalesce(nt, TIMESTAMP '2024-02-15') > t + INTERVAL 120 MINUTE)
SELECT q.account_id, q.t last_at, count(DISTINCT record_id) records FROM q JOIN a ON a.account_id = q.account_id AND a.t <= q.t AND a.t > q.t - INTERVAL 120 MINUTE GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= 2""",
}
