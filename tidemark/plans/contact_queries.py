"""Registered contact queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import contacts as C
from tidemark.plans.lineage import shared_folder
from tidemark.sources import csv_files, split_csv
from tidemark.sources.views import CONTACTS_SQL, contacts


def _flagged(s, d):
    return C.flagged(contacts(s, d))


def _some_left_out(s, d):
    return C.exclude(_flagged(s, d), contacts(s, d).where("contact_id LIKE '%4'"))


def _overloaded(s, d):
    return _flagged(s, d).withColumn("owner_id", F.when(F.col("owner_id") == "NE-ENT-01", "NE-ENT").otherwise(F.col("owner_id")))


def _show(df, *columns):
    return df.select("contact_id", *columns, F.array_join(F.sort_array("quality_flags"), "|").alias("flags"))


CSV_COLUMNS = ("contact_id", "full_name", "raw_email", "company", "owner_id")


def _csv_files(s, d):
    """Contacts written as CSV files and read again in blocks; some companies hold line ends, quotes and commas."""
    folder = f"{shared_folder(s)}/tidemark-csv-{uuid.uuid4().hex}"
    odd = F.when(F.col("contact_id").endswith("1"), F.lit('\n"Ltd", é\r\n')).when(F.col("contact_id").endswith("7"), F.lit('"')).otherwise("")
    people = contacts(s, d).withColumn("company", F.concat(F.coalesce("company", F.lit("")), odd)).select(*CSV_COLUMNS)
    csv_files.write_lines(csv_files.csv_lines(people, CSV_COLUMNS, guard=False), folder, ",".join(CSV_COLUMNS))
    return split_csv.read_documents(s, folder).select(*(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(CSV_COLUMNS)), "error")


QUERIES = {
    "contact_csv_files": _csv_files,
    "contact_flags": lambda s, d: _show(_flagged(s, d), "normalized_email"),
    "contact_audit": lambda s, d: C.audit(_flagged(s, d)),
    "contact_priorities": lambda s, d: C.priorities(_flagged(s, d)),
    "contact_ready": lambda s, d: _flagged(s, d).where(C.is_ready()).select("contact_id", "normalized_email"),
    "repair_merge": lambda s, d: _show(C.repair(_flagged(s, d), "merge"), "canonical_contact_id", "record_status"),
    "repair_reroute": lambda s, d: _show(C.repair(_flagged(s, d), "reroute"), "owner_id", "last_action"),
    "repair_replay": lambda s, d: _show(C.repair(_flagged(s, d), "replay"), "lifecycle_stage", "last_action"),
    "repair_chain": lambda s, d: C.audit(C.replay(C.reroute(C.merge(_flagged(s, d))))).select("active", "ready", "n_duplicate_identity", "n_missing_owner", "n_stage_regression"),
    "warehouse_merge": lambda s, d: _show(C.warehouse_merge(_some_left_out(s, d)), "canonical_contact_id", "record_status", "last_action"),
    "warehouse_reroute": lambda s, d: _show(C.warehouse_reroute(_overloaded(s, d)), "owner_id", "last_action"),
    "warehouse_replay": lambda s, d: _show(C.warehouse_replay(_some_left_out(s, d)), "lifecycle_stage", "last_action"),
    "repair_receipt": lambda s, d: C.warehouse_repair(_some_left_out(s, d), "duplicate-surge", "approve", "req-1", "2024-02-01 00:00:00")["receipt"],
    "repair_event": lambda s, d: C.warehouse_repair(_overloaded(s, d), "routing-overload", "approve", "req-2", "2024-02-01 00:00:00")["event"].select("event_id", "event_type", "region", "route_seconds", "is_duplicate"),
    "repair_run": lambda s, d: C.warehouse_repair(_some_left_out(s, d), "stage-regression", "approve", "req-3", "2024-02-01 00:00:00")["run"],
    "contact_exclusions": lambda s, d: _show(C.exclude(_flagged(s, d), contacts(s, d).where("contact_id LIKE '%4'")), "excluded"),
    "contact_funnel": lambda s, d: C.stage_funnel(_flagged(s, d)),
    "contact_corrections": lambda s, d: _show(C.correct(_flagged(s, d), contacts(s, d).where("owner_id = ''").select("contact_id", F.lit("OWN-9").alias("owner_id"))), "owner_id"),
}

_rank = "CASE {0} WHEN 'lead' THEN 1 WHEN 'mql' THEN 2 WHEN 'sql' THEN 3 WHEN 'opportunity' THEN 4 WHEN 'closed_won' THEN 5 ELSE 0 END"


def _flag_sql(source: str, excluded: str = "false") -> str:
    """CTEs f0 and f: contacts with list columns of flags."""
    return f"""f0 AS (SELECT *, CASE WHEN regexp_full_match(lower(trim(raw_email)), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower(trim(raw_email)) END normalized_email, {excluded} AS excluded FROM {source}),
f AS (SELECT *, list_sort(list_filter([CASE WHEN normalized_email IS NULL THEN 'invalid_email' END, CASE WHEN trim(company) = '' THEN 'missing_company' END, CASE WHEN trim(owner_id) = '' THEN 'missing_owner' END, CASE WHEN contains(split_part(raw_email, '@', 1), '+') THEN 'plus_address_present' END,
 CASE WHEN {_rank.format('lifecycle_stage')} < {_rank.format('expected_lifecycle_stage')} THEN 'stage_regression' END, CASE WHEN NOT excluded AND normalized_email IS NOT NULL AND count(*) FILTER (WHERE NOT excluded) OVER (PARTITION BY normalized_email) > 1 THEN 'duplicate_identity' END], lambda x: x IS NOT NULL)) fl FROM f0)"""


F_SQL = f"WITH {CONTACTS_SQL}, {_flag_sql('contacts')} "
_B = "list_has_any(fl, ['invalid_email','duplicate_identity','missing_company','missing_owner','stage_regression'])"
_n = lambda f: f"count(*) FILTER (WHERE list_contains(fl, '{f}')) n_{f}"
_drop = lambda f: f"array_to_string(list_filter(fl, lambda x: x <> '{f}'), '|')"
_canon = "first_value(contact_id) OVER (PARTITION BY normalized_email ORDER BY CAST(raw_email <> lower(trim(raw_email)) AS INTEGER), contact_id)"
_m = f"m AS (SELECT *, list_contains(fl, 'duplicate_identity') d, {_canon} canon FROM f)"
_W = f"WITH {CONTACTS_SQL}, {_flag_sql('contacts', 'contact_id LIKE $$%4$$')}, m AS (SELECT *, list_contains(fl, 'duplicate_identity') d, first_value(contact_id) OVER (PARTITION BY normalized_email, list_contains(fl, 'duplicate_identity') ORDER BY CAST(raw_email <> lower(trim(raw_email)) AS INTEGER), contact_id) canon FROM f), o AS (SELECT *, d AND canon <> contact_id other FROM m) "
_re = "(lower(region) = 'northeast' AND lower(segment) = 'enterprise' AND owner_id <> 'NE-ENT-OVERFLOW')"
ORACLES = {
    "contact_csv_files": f"""WITH {CONTACTS_SQL} SELECT coalesce(contact_id, '') contact_id, coalesce(full_name, '') full_name, coalesce(raw_email, '') raw_email, coalesce(company, '') || CASE WHEN contact_id LIKE '%1' THEN chr(10) || '"Ltd", é' || chr(13) || chr(10) WHEN contact_id LIKE '%7' THEN '"' ELSE '' END company, coalesce(owner_id, '') owner_id, CAST(NULL AS VARCHAR) AS error FROM contacts""",
    "contact_flags": F_SQL + "SELECT contact_id, normalized_email, array_to_string(fl, '|') flags FROM f",
    "contact_audit": F_SQL
    + f"""SELECT *, CASE WHEN readiness >= 90 THEN 'Ready' WHEN readiness >= 70 THEN 'Needs cleanup' WHEN readiness >= 40 THEN 'At risk' ELSE 'Blocked' END label, n_duplicate_identity - duplicate_groups + n_stage_regression automatable FROM (SELECT *, CASE WHEN active = 0 THEN 0 ELSE CAST(floor(ready * 100.0 / active + 0.5) AS BIGINT) END readiness FROM (
SELECT count(*) AS rows, count(*) active, count(*) FILTER (WHERE NOT {_B}) ready, {', '.join(_n(f) for f in (*C.BLOCKING, 'plus_address_present', 'unicode_domain_present'))}, count(DISTINCT CASE WHEN list_contains(fl, 'duplicate_identity') THEN normalized_email END) duplicate_groups FROM f))""",
    "contact_priorities": F_SQL + "SELECT flag, count(*) n, flag IN ('invalid_email','duplicate_identity','missing_company','missing_owner','stage_regression') blocking FROM (SELECT unnest(fl) flag FROM f) GROUP BY ALL",
    "contact_ready": F_SQL + f"SELECT contact_id, normalized_email FROM f WHERE NOT {_B}",
    "repair_merge": F_SQL + f", {_m} SELECT contact_id, CASE WHEN d THEN canon END canonical_contact_id, CASE WHEN d AND canon <> contact_id THEN 'merged' ELSE 'active' END record_status, CASE WHEN d AND canon = contact_id THEN {_drop('duplicate_identity')} ELSE array_to_string(fl, '|') END flags FROM m",
    "repair_reroute": F_SQL + f"SELECT contact_id, CASE WHEN {_re} THEN 'NE-ENT-OVERFLOW' ELSE owner_id END owner_id, CASE WHEN {_re} THEN 'reroute' END last_action, CASE WHEN {_re} THEN {_drop('missing_owner')} ELSE array_to_string(fl, '|') END flags FROM f",
    "repair_replay": F_SQL + f"SELECT contact_id, CASE WHEN list_contains(fl, 'stage_regression') THEN expected_lifecycle_stage ELSE lifecycle_stage END lifecycle_stage, CASE WHEN list_contains(fl, 'stage_regression') THEN 'replay' END last_action, {_drop('stage_regression')} flags FROM f",
    "repair_chain": F_SQL
    + f""", {_m}, r AS (SELECT list_filter(fl, lambda x: x NOT IN ('duplicate_identity', 'stage_regression') AND NOT (x = 'missing_owner' AND {_re})) fl FROM m WHERE NOT (d AND canon <> contact_id))
SELECT count(*) active, count(*) FILTER (WHERE NOT {_B}) ready, {_n('duplicate_identity')}, {_n('missing_owner')}, {_n('stage_regression')} FROM r""",
    "warehouse_merge": _W + f"SELECT contact_id, CASE WHEN other THEN canon END canonical_contact_id, CASE WHEN other THEN 'merged' ELSE 'active' END record_status, CASE WHEN other THEN 'merged_into_canonical' WHEN d THEN 'canonical_record_retained' END last_action, CASE WHEN other THEN array_to_string(fl, '|') ELSE {_drop('duplicate_identity')} END flags FROM o",
    "warehouse_reroute": F_SQL + "SELECT contact_id, CASE WHEN owner_id <> 'NE-ENT-01' THEN owner_id WHEN region = 'Northeast' AND segment = 'Enterprise' THEN 'CE-ENT-OVERFLOW' ELSE 'NE-ENT' END owner_id, CASE WHEN owner_id = 'NE-ENT-01' AND region = 'Northeast' AND segment = 'Enterprise' THEN 'rerouted_from_ne_enterprise' END last_action, array_to_string(fl, '|') flags FROM f",
    "warehouse_replay": _W + f"SELECT contact_id, CASE WHEN list_contains(fl, 'stage_regression') THEN expected_lifecycle_stage ELSE lifecycle_stage END lifecycle_stage, CASE WHEN list_contains(fl, 'stage_regression') THEN 'lifecycle_replayed' END last_action, {_drop('stage_regression')} flags FROM o",
    "repair_receipt": _W + "SELECT true accepted, 'executed' status, 'duplicate-surge' scenario, 'approve' AS action, 'req-1' request_id, 'REPAIR-duplicate-surge-req-1' event_id, count(*) FILTER (WHERE other) affected_records, TIMESTAMP '2024-02-01' approved_at FROM o",
    "repair_event": "SELECT 'REPAIR-routing-overload-req-2' event_id, 'repair_executed_routing-overload' event_type, 'routing-overload' region, 0 route_seconds, false is_duplicate",
    "repair_run": _W + "SELECT 'req-3' run_id, 'stage-regression' scenario, 'approve' AS action, 'executed' status, count(*) FILTER (WHERE list_contains(fl, 'stage_regression')) affected_records, TIMESTAMP '2024-02-01' started_at, TIMESTAMP '2024-02-01' finished_at FROM o",
    "contact_exclusions": f"WITH {CONTACTS_SQL}, {_flag_sql('contacts', 'contact_id LIKE $$%4$$')} SELECT contact_id, excluded, array_to_string(fl, '|') flags FROM f",
    "contact_funnel": F_SQL + " UNION ALL ".join(f"SELECT '{s}' stage, count(*) FILTER (WHERE {_rank.format('lifecycle_stage')} >= {i + 1}) n FROM f" for i, s in enumerate(C.STAGES)),
    "contact_corrections": f"WITH {CONTACTS_SQL}, fixed AS (SELECT * REPLACE (CASE WHEN owner_id = '' THEN 'OWN-9' ELSE owner_id END AS owner_id) FROM contacts), {_flag_sql('fixed')} SELECT contact_id, owner_id, array_to_string(fl, '|') flags FROM f",
}
