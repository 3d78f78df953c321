"""Registered mart queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import marts
from tidemark.sources.views import CRM_EVENTS_SQL, crm_events

S = "('lead','mql','sql','opportunity','closed_won')"
STAGED = f"""WITH {CRM_EVENTS_SQL},
staged AS (SELECT * EXCLUDE r FROM (SELECT event_id, lead_id, account_id, lower(trim(event_type)) event_type, event_timestamp, lower(trim(lifecycle_stage)) lifecycle_stage, trim(region) region, trim(segment) segment, owner_id, route_seconds, opportunity_amount, is_duplicate, ingested_at,
 row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, lifecycle_stage DESC, event_timestamp DESC) r FROM crm_events) WHERE r = 1)
"""


def _staged(spark, d):
    return marts.staged(crm_events(spark, d))


def _violations(spark, d):
    s = _staged(spark, d)
    out = marts.violations(s, "events", "accepted_values", "lifecycle_stage", marts.STAGES)
    for kind, c in (("not_null", "owner_id"), ("unique", "event_id"), ("nonnegative", "route_seconds")):
        out = out.unionByName(marts.violations(s, "events", kind, c))
    return out


QUERIES = {
    "staged_events": lambda s, d: _staged(s, d).select("event_id", "lead_id", "event_type", "lifecycle_stage", "region", "segment", "owner_id", "route_seconds", "opportunity_amount", "is_duplicate"),
    "mart_funnel": lambda s, d: marts.funnel(_staged(s, d)),
    "mart_routing_sla": lambda s, d: marts.routing_sla(_staged(s, d)),
    "mart_data_quality": lambda s, d: marts.data_quality(_staged(s, d)),
    "live_state": lambda s, d: marts.live_state(crm_events(s, d)),
    "latest_events_json": lambda s, d: marts.latest_json(crm_events(s, d)),
    "constraint_violations": _violations,
    "source_freshness": lambda s, d: marts.freshness(crm_events(s, d), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("status"),
    "stage_conversion": lambda s, d: marts.conversion(crm_events(s, d)),
}
_reach = ", ".join(f"count(DISTINCT CASE WHEN lifecycle_stage IN ({', '.join(repr(x) for x in marts.STAGES[i:])}) THEN lead_id END) {s}s" for i, s in enumerate(marts.STAGES))
_live = ", ".join(f"count(*) FILTER (WHERE lifecycle_stage = '{s}') n_{s}" for s in marts.STAGES)
_rank = "CASE lifecycle_stage " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(marts.STAGES)) + " ELSE 1 END"
ORACLES = {
    "staged_events": STAGED + "SELECT event_id, lead_id, event_type, lifecycle_stage, region, segment, owner_id, route_seconds, opportunity_amount, is_duplicate FROM staged",
    "mart_funnel": STAGED + f"SELECT CAST(date_trunc('month', event_timestamp) AS DATE) AS month, segment, region, {_reach}, CAST(coalesce(sum(CASE WHEN lifecycle_stage = 'closed_won' THEN opportunity_amount END), 0) AS BIGINT) won_revenue FROM staged GROUP BY ALL",
    "mart_routing_sla": STAGED + "SELECT CAST(event_timestamp AS DATE) AS day, region, count(*) routed, CAST(quantile_disc(route_seconds, 0.5) AS DOUBLE) median_seconds, round(count(*) FILTER (WHERE route_seconds <= 120) / CAST(count(*) AS DOUBLE), 6) attainment, count(*) FILTER (WHERE route_seconds > 120) breaches FROM staged WHERE event_type = 'lifecycle_changed' GROUP BY ALL",
    "mart_data_quality": STAGED
    + f"SELECT *, round((events - duplicates - missing_owner - invalid_stage) / CAST(events AS DOUBLE), 6) quality_rate FROM (SELECT CAST(event_timestamp AS DATE) AS day, count(*) events, count(*) FILTER (WHERE is_duplicate) duplicates, count(*) FILTER (WHERE owner_id IS NULL) missing_owner, count(*) FILTER (WHERE lifecycle_stage NOT IN {S}) invalid_stage FROM staged GROUP BY ALL)",
    "live_state": f"""WITH {CRM_EVENTS_SQL}, r AS (SELECT * FROM crm_events WHERE event_timestamp >= (SELECT max(event_timestamp) FROM crm_events) - INTERVAL 30 DAY)
SELECT count(*) events, count(DISTINCT lead_id) leads, {_live}, coalesce(CAST(quantile_disc(route_seconds, 0.5) AS DOUBLE), 0) median_seconds, round(count(*) FILTER (WHERE route_seconds <= 120) * 100.0::DOUBLE / greatest(count(*), 1), 1) sla_percent,
 round(count(*) FILTER (WHERE owner_id IS NULL) * 100.0::DOUBLE / greatest(count(*), 1), 1) unowned_percent, count(*) FILTER (WHERE is_duplicate) duplicates, CAST(coalesce(sum(CASE WHEN lifecycle_stage = 'closed_won' THEN opportunity_amount END), 0) AS BIGINT) won_revenue,
 max(CASE WHEN starts_with(lifecycle_stage, 'closed') THEN event_timestamp END) last_won_at, first(owner_id ORDER BY event_timestamp DESC, event_id DESC) FILTER (WHERE owner_id IS NOT NULL) latest_owner FROM r""",
    "latest_events_json": f"""WITH {CRM_EVENTS_SQL}, t AS (SELECT * FROM crm_events ORDER BY event_timestamp DESC, event_id DESC, lifecycle_stage DESC LIMIT 6)
SELECT '[' || string_agg('{{"id":"' || event_id || '","stage":"' || lifecycle_stage || '"}}', ',' ORDER BY event_timestamp DESC, event_id DESC, lifecycle_stage DESC) || ']' events_json FROM t""",
    "constraint_violations": STAGED
    + f"""SELECT 'events.accepted_values' AS "check", 'lifecycle_stage' AS "column", lifecycle_stage AS value, count(*) n FROM staged WHERE lifecycle_stage NOT IN {S} GROUP BY ALL
UNION ALL SELECT 'events.not_null', 'owner_id', owner_id, count(*) FROM staged WHERE owner_id IS NULL GROUP BY ALL
UNION ALL SELECT 'events.unique', 'event_id', event_id, count(*) FROM staged WHERE event_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'events.nonnegative', 'route_seconds', CAST(route_seconds AS VARCHAR), count(*) FROM staged WHERE route_seconds < 0 GROUP BY ALL""",
    "source_freshness": f"WITH {CRM_EVENTS_SQL} SELECT CASE WHEN epoch(TIMESTAMP '2024-02-01') - epoch(max(ingested_at)) > 21600 THEN 'error' WHEN epoch(TIMESTAMP '2024-02-01') - epoch(max(ingested_at)) > 7200 THEN 'warn' ELSE 'ok' END status FROM crm_events",
    "stage_conversion": f"WITH {CRM_EVENTS_SQL}, b AS (SELECT lead_id, max({_rank}) r FROM crm_events GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT CAST({i + 1} AS INTEGER) AS rank, '{s}' AS stage, count(*) FILTER (WHERE r >= {i + 1}) leads, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE r >= {i + 1}) * 100.0::DOUBLE / count(*), 1) END AS percent FROM b" for i, s in enumerate(marts.STAGES)),
}
