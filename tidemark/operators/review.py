"""From a saved import to a reviewed write plan: eligibility, portable values, coverage of the snapshot, create reviews, plans, claims, row status, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# The fields that both CRMs take, their longest values, the flags that hold a row, the age of a snapshot in seconds.
FIELDS = ("first_name", "last_name", "company", "phone", "job_title", "website")
LIMITS = {
    "hubspot": {"contact_id": 120, "email": 254, "first_name": 255, "last_name": 255, "company": 255, "phone": 50, "job_title": 255, "website": 500},
    "salesforce": {"contact_id": 120, "email": 80, "first_name": 40, "last_name": 80, "company": 255, "phone": 40, "job_title": 128, "website": 255},
}
HOLDING = ("duplicate_identity", "invalid_email", "stage_regression")
SNAPSHOT_SECONDS, BATCH = 900, 100
SUSPICIOUS = r"(?i)^(?:n/?a|none|null|unknown|not (?:available|applicable)|tbd|[-?]+)$"
INVISIBLE = r"^[\s\x00-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}]*[=+\-@]|^[\t\r\n]"


def _there(c: Column) -> Column:
    return T.trimmed(F.coalesce(c, F.lit(""))) != ""


def _clean(c: Column) -> Column:
    return F.when(_there(c), T.trimmed(c))


def eligible(provider: str) -> Column:
    """Whether a flagged contact may go to a CRM."""
    base = (F.col("record_status") == "active") & ~F.col("excluded") & F.col("normalized_email").isNotNull() & ~F.arrays_overlap("quality_flags", F.array(*map(F.lit, HOLDING)))
    if provider == "hubspot":
        return base
    last = F.coalesce(_clean(F.col("last_name")), T.split_name(F.col("full_name"))[1])
    return base & (F.length("normalized_email") <= 80) & _there(F.col("company")) & _there(last)


def portable(df: DataFrame, provider: str, cut: bool = True) -> DataFrame:
    """contact_id, email and FIELDS as a CRM takes them, with too_long: the fields beyond its limits. Long values are cut off, or (cut=False: updates) left whole for the caller to refuse."""
    first, last = T.split_name(F.col("full_name"))
    value = {"contact_id": T.trimmed(F.col("contact_id")), "email": F.lower(T.trimmed(F.col("normalized_email"))), "first_name": F.coalesce(_clean(F.col("first_name")), first, F.lit("")), "last_name": F.coalesce(_clean(F.col("last_name")), last, F.lit(""))}
    value |= {c: _clean(F.col(c)) for c in FIELDS[2:]}
    limit = LIMITS[provider]
    long = F.array_compact(F.array(*(F.when(F.length(v) > limit[c], F.lit(c)) for c, v in value.items())))
    return df.select(*((F.substring(v, 1, limit[c]) if cut else v).alias(c) for c, v in value.items()), long.alias("too_long"))


def batch_faults(batches: DataFrame) -> DataFrame:
    """(batch, rows, fault) of rows (batch, contact_id, email): empty or too long batches can't be rows here, so faults are size, repeated ids and repeated emails; null: none."""
    per = batches.groupBy("batch").agg(F.count("*").alias("rows"), F.countDistinct(F.trim("contact_id")).alias("ids"), F.countDistinct(F.lower("email")).alias("emails"))
    fault = F.when(F.col("rows") > BATCH, "size").when(F.col("ids") < F.col("rows"), "repeated_id").when(F.col("emails") < F.col("rows"), "repeated_email")
    return per.select("batch", "rows", fault.alias("fault"))


def snapshot_issue(workspace: str, connector: str, as_of: Column) -> Column:
    """Why a snapshot (workspace_id, connector_id, complete, source_complete, started_at) can't back creates; null: it can."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return (
        F.when(~F.col("workspace_id").eqNullSafe(F.lit(workspace)) | ~F.col("connector_id").eqNullSafe(F.lit(connector)), "other_source")
        .when(~(F.coalesce("complete", F.lit(False)) & F.coalesce("source_complete", F.lit(False))), "incomplete")
        .when(age.isNull() | (age < 0) | (age > SNAPSHOT_SECONDS), "stale")
    )


def create_reviews(proposed: DataFrame, crm_matches: DataFrame, import_matches: DataFrame, usable: DataFrame, issue: str | None) -> DataFrame:
    """(contact_id, status, reason, crm_candidates, import_candidates) of proposed rows (contact_id). Matches: (input_id, ...), one row per candidate. usable: contact_id of rows with a saved identity. issue: of the snapshot, which holds all."""
    count = lambda d, name: d.groupBy(F.col("input_id").alias("contact_id")).agg(F.count("*").alias(name))
    rows = proposed.select("contact_id").join(count(crm_matches, "crm_candidates"), "contact_id", "left").join(count(import_matches, "import_candidates"), "contact_id", "left")
    rows = rows.join(usable.select("contact_id").distinct().withColumn("usable", F.lit(True)), "contact_id", "left").fillna(0, ["crm_candidates", "import_candidates"])
    reason = F.when(F.lit(issue is not None), F.lit(issue)).when(F.col("usable").isNull(), "no_saved_identity").when(F.col("crm_candidates") + F.col("import_candidates") > 0, "possible_duplicates")
    return rows.select("contact_id", F.when(reason.isNull(), "clear").otherwise("held").alias("status"), reason.alias("reason"), "crm_candidates", "import_candidates")


def source_key(*columns: str) -> Column:
    """Digest of a row's trimmed values (blank: null), which a confirmed match keeps."""
    return F.sha2(F.to_json(F.array(*(_clean(F.col(c).cast("string")) for c in columns)), {"ignoreNullFields": "false"}), 256)


def valid_decisions(decisions: DataFrame, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(contact_id, native_id, fault) of confirmed matches (contact_id, native_id, row_key, target_key) held against today's keys of rows (contact_id, row_key) and targets (native_id, target_key); fault null: still valid."""
    r, t = rows.select("contact_id", F.col("row_key").alias("__r")), targets.select("native_id", F.col("target_key").alias("__t"))
    j = decisions.join(r, "contact_id", "left").join(t, "native_id", "left")
    fault = F.when(~F.col("__r").eqNullSafe(F.col("row_key")), "row_changed").when(~F.col("__t").eqNullSafe(F.col("target_key")), "target_changed")
    return j.select("contact_id", "native_id", fault.alias("fault"))


def claims(rows: DataFrame, targets: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(native_id, contact_id) of rows (contact_id, email) that reach a target (native_id, emails: all of them) by any of its emails or by a decision (contact_id, native_id), where a target has several."""
    mail = lambda c: F.lower(F.trim(c))
    reach = targets.select("native_id", F.explode("emails").alias("e")).select("native_id", mail(F.col("e")).alias("e")).where("e <> ''").join(rows.select("contact_id", mail(F.col("email")).alias("e")), "e").select("native_id", "contact_id")
    if decisions is not None:
        reach = reach.union(decisions.select("native_id", "contact_id"))
    reach = reach.distinct()
    many = reach.groupBy("native_id").agg(F.count("*").alias("n")).where("n > 1").select("native_id")
    return reach.join(many, "native_id")


#: What two people are compared by, in normal form.
COMPARED = {"first_name": T.name, "last_name": T.name, "company": T.company, "phone": T.phone}


def contradictory(a, b) -> Column:
    """Whether two people (each a function from a field to a column in normal form) of one email have unlike first and last names and another company or phone."""
    unlike = lambda c: F.coalesce(T.dice(a(c), b(c)) < 0.55, F.lit(False))
    differs = lambda c: F.coalesce(a(c) != b(c), F.lit(False))
    return unlike("first_name") & unlike("last_name") & (differs("company") | differs("phone"))


def valid_value(field: str, value: Column) -> Column:
    ok = ~value.rlike(SUSPICIOUS)
    if field == "phone":
        return ok & T.phone(value).isNotNull()
    if field == "website":
        return ok & value.rlike(r"(?i)^(?:https?://)?[^\s/@:?#]+\.[^\s/@:?#]+(?:[:/?#]\S*)?$")
    return ok


def governed_plan(proposed: DataFrame, existing: DataFrame, provider: str, update_only: bool = True, fields: tuple[str, ...] = FIELDS, fill_only: bool = True, clear_blanks: bool = False, contact_updates: bool = False, excluded: DataFrame | None = None, reviews: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """(contact_id, operation, reason, native_id, matches, decisions): create, update, unchanged or hold of each proposed row (contact_id, email, FIELDS).

    existing: (native_id, object_type, email, converted, FIELDS). excluded: (contact_id, reason). reviews: of creates (contact_id, status, reason). decisions: confirmed
    matches (contact_id, native_id). The first rule that applies holds a row; decisions is a list of (field, before, after, action, why) of rows that aren't held."""
    mail = F.lower(F.trim("email"))
    # normal forms before the joins: their folding can't run inside the comparison
    target = F.struct("native_id", F.lower(F.trim("email")).alias("email"), "object_type", "converted", *FIELDS, *(f"n_{c}" for c in COMPARED))
    existing = existing.withColumns({f"n_{c}": f(F.col(c)) for c, f in COMPARED.items()})
    proposed = proposed.withColumns({f"__n_{c}": f(F.col(c)) for c, f in COMPARED.items()})
    found = existing.groupBy(mail.alias("__m")).agg(F.count("*").alias("matches"), F.min(target).alias("t"))
    rows = proposed.withColumn("__e", mail).join(found, F.col("__e") == F.col("__m"), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    empty = proposed.select("contact_id").limit(0)
    with_reason = lambda d, name: (empty.withColumn(name, F.lit(None).cast("string")) if d is None else d.select("contact_id", F.coalesce("reason", F.lit("")).alias(name)))
    rows = rows.join(with_reason(excluded, "__out"), "contact_id", "left")
    rows = rows.join(with_reason(None if reviews is None else reviews.where("status = 'held'"), "__held"), "contact_id", "left")
    rows = rows.join(empty.withColumn("__sure", F.lit(None).cast("string")) if decisions is None else decisions.select("contact_id", F.col("native_id").alias("__sure")), "contact_id", "left")
    # an input that is left out claims no target
    several = rows.where("__out IS NULL AND matches = 1").groupBy(F.col("t.native_id").alias("__t"), F.col("t.object_type").alias("__o")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(several, (F.col("matches") == 1) & (F.col("t.native_id") == F.col("__t")) & F.col("t.object_type").eqNullSafe(F.col("__o")), "left")
    t = lambda c: F.col("t")[c]
    person = (F.lit(provider == "salesforce")) & (t("object_type") == "contact")
    hold = (
        F.when(F.col("__out").isNotNull(), "excluded")
        .when(F.col("matches") > 1, "several_matches")
        .when(F.col("__sure").isNotNull() & ~((F.col("matches") == 1) & (t("native_id") == F.col("__sure"))), "confirmed_match_gone")
        .when((F.col("matches") == 0) & F.col("__held").isNotNull(), "create_review_held")
        .when((F.col("matches") == 0) & F.lit(update_only), "no_match")
        .when(F.col("__t").isNotNull(), "shared_target")
        .when(person & F.lit(not contact_updates), "existing_contact")
        .when(F.lit(provider == "salesforce") & (t("object_type") == "lead") & ~t("converted").eqNullSafe(F.lit(False)), "converted_lead")
        .when(F.lit(update_only) & F.col("__sure").isNull() & (F.col("matches") == 1) & contradictory(lambda c: F.col(f"__n_{c}"), lambda c: t(f"n_{c}")), "contradiction")
    )

    def step(c: str) -> Column:
        before, given = _clean(t(c)), _clean(F.col(c))
        keep = lambda action, why: F.struct(F.lit(c).alias("field"), before.alias("before"), before.alias("after"), F.lit(action).alias("action"), F.lit(why).alias("why"))
        put = lambda action, why: F.struct(F.lit(c).alias("field"), before.alias("before"), given.alias("after"), F.lit(action).alias("action"), F.lit(why).alias("why"))
        new = F.when(given.isNull(), put("unchanged", "new_record")).otherwise(put("fill", "new_record"))
        fills = F.when(before.isNull() & given.isNotNull(), put("fill", "fill_empty")).when(given.isNull(), put("review", "explicit_clear")).otherwise(put("review", "explicit_replace"))
        old = (
            F.when(person & F.lit(c in ("company", "website")), keep("preserve", "account_field"))
            .when(F.lit(update_only) & before.rlike(SUSPICIOUS), keep("review", "suspicious_value"))
            .when(F.lit(c not in fields), keep("preserve", "not_selected"))
            .when(F.lit(update_only) & given.isNotNull() & ~valid_value(c, given), keep("review", "invalid_value"))
            .when(before.eqNullSafe(given), keep("unchanged", "same_value"))
            .when(given.isNull() & F.lit(not clear_blanks), keep("preserve", "blank_import"))
            .when(F.lit(fill_only) & before.isNotNull(), keep("preserve", "populated"))
            .otherwise(fills)
        )
        return F.when(F.col("matches") == 0, new).otherwise(old)

    rows = rows.withColumn("__hold", hold).withColumn("decisions", F.when(F.col("__hold").isNull(), F.array(*map(step, FIELDS))))
    changed = F.exists("decisions", lambda d: ~d["before"].eqNullSafe(d["after"]))
    operation = F.when(F.col("__hold").isNotNull(), "hold").when(F.col("matches") == 0, "create").when(changed, "update").otherwise("unchanged")
    native = F.when(F.col("__hold").isNull(), t("native_id"))
    return rows.select("contact_id", operation.alias("operation"), F.col("__hold").alias("reason"), native.alias("native_id"), F.col("matches").cast("long").alias("matches"), "decisions")


def decision_text(decisions: Column) -> Column:
    """field:action:why of decisions that are neither the same nor new blanks, joined."""
    told = F.filter(decisions, lambda d: ~d["why"].isin("same_value", "not_selected"))
    return F.array_join(F.transform(told, lambda d: F.concat_ws(":", d["field"], d["action"], d["why"])), "|")


def classified(contacts: DataFrame, plan: DataFrame, claimed: DataFrame, original: DataFrame) -> DataFrame:
    """(contact_id, status, reason) of a safe import's rows: skipped, held, proposed_update, unchanged, unmatched or unresolved, and what was removed from the original (contact_id) as skipped. claimed: from ``claims``."""
    many = claimed.select("contact_id").distinct().withColumn("__many", F.lit(True))
    rows = contacts.select("contact_id", "record_status", "excluded", eligible("hubspot").alias("ok")).join(plan.select("contact_id", "operation", F.col("reason").alias("why")), "contact_id", "left").join(many, "contact_id", "left")
    status = (
        F.when(F.col("excluded") | (F.col("record_status") != "active"), "skipped")
        .when(~F.col("ok"), "held")
        .when(F.col("operation").isNull(), "unresolved")
        .when(F.col("__many"), "held")
        .when(F.col("operation") == "update", "proposed_update")
        .when(F.col("operation") == "unchanged", "unchanged")
        .when(F.col("why") == "no_match", "unmatched")
        .otherwise("held")
    )
    reason = F.when(status == "skipped", "merged_or_excluded").when(~F.col("ok"), "flags").when(F.col("operation").isNull(), "not_checked").when(F.col("__many"), "shared_target").otherwise(F.coalesce("why", F.lit("")))
    gone = original.select("contact_id").join(contacts.select("contact_id"), "contact_id", "left_anti")
    return rows.select("contact_id", status.alias("status"), reason.alias("reason")).unionByName(gone.select("contact_id", F.lit("skipped").alias("status"), F.lit("removed").alias("reason")))


def review_rows(plan: DataFrame, receipts: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per contact of a plan (contact_id, operation, native_id, reason), of receipts (contact_id, status, native_id, error) or both. Checks (contact_id, native_id, status) count only for a contact whose created or updated record they name."""
    p = plan.select("contact_id", F.col("operation").alias("planned_action"), F.col("native_id").alias("__p"), F.col("reason").alias("__why"))
    r = receipts.select("contact_id", F.col("status").alias("__s"), F.col("native_id").alias("__r"), F.col("error").alias("__err"), F.lit(True).alias("__got"))
    c = checks.select("contact_id", F.col("native_id").alias("__c"), F.col("status").alias("__v"))
    rows = p.join(r, "contact_id", "full_outer").join(c, "contact_id", "left")
    proven = F.col("planned_action").isNotNull() & F.col("__s").isin("created", "updated") & F.col("__c").eqNullSafe(F.col("__r"))
    native = F.when(F.col("__got"), F.col("__r")).otherwise(F.col("__p"))
    why = F.coalesce(F.when(F.col("__err") != "", F.col("__err")), F.when(F.col("__why") != "", F.col("__why")), F.lit(""))
    return rows.select("contact_id", "planned_action", F.coalesce("__s", F.lit("no_receipt")).alias("outcome"), native.alias("native_id"), why.alias("reason"), F.when(proven, F.col("__v")).alias("verification_status"))


def report_cell(value: Column) -> Column:
    """A cell of a report for spreadsheets: always quoted, with a quote before what a spreadsheet would run, hidden signs before it or not."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(INVISIBLE), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def report_lines(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(contact_id, line) of a report, without its header."""
    return rows.select("contact_id", F.concat_ws(",", *(report_cell(F.col(c)) for c in columns)).alias("line"))


def rollbacks(plan: DataFrame, current: DataFrame) -> DataFrame:
    """(contact_id, native_id, state) of a plan's updates against today's records (native_id, FIELDS): restorable if the changed fields still are as written, restored if they are as before, else changed; missing without a record."""
    now = current.select("native_id", F.array(*(F.struct(F.lit(c).alias("field"), _clean(F.col(c)).alias("v")) for c in FIELDS)).alias("__now"))
    touched = F.filter("decisions", lambda d: ~d["before"].eqNullSafe(d["after"]))
    rows = plan.where("operation = 'update'").join(now, "native_id", "left")
    at = lambda d: F.filter("__now", lambda n: n["field"] == d["field"])[0]["v"]
    are = lambda side: F.forall(touched, lambda d: at(d).eqNullSafe(d[side]))
    state = F.when(F.col("__now").isNull(), "missing").when(are("after"), "restorable").when(are("before"), "restored").otherwise("changed")
    return rows.select("contact_id", "native_id", state.alias("state"))


def decision_report(before: DataFrame, after: DataFrame, blocking: tuple[str, ...]) -> DataFrame:
    """(contact_id, status, merged_from, changed, hold_flags, information) of contacts before and after repairs."""
    merged = after.where("record_status = 'merged' AND canonical_contact_id IS NOT NULL").groupBy(F.col("canonical_contact_id").alias("contact_id")).agg(F.array_join(F.sort_array(F.collect_list("contact_id")), "|").alias("merged_from"))
    fields = ("owner_id", "lifecycle_stage", "record_status")
    was = before.select("contact_id", *(F.col(c).alias(f"__{c}") for c in fields))
    rows = after.join(was, "contact_id").join(merged, "contact_id", "left")
    holds = F.filter("quality_flags", lambda f: f.isin(*blocking))
    status = F.when(F.col("record_status") == "merged", "Merged").when((F.size(holds) == 0) & (F.col("record_status") == "active") & ~F.col("excluded"), "Ready").otherwise("Held")
    changed = F.array_join(F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in fields))), "|")
    joined = lambda a: F.array_join(F.sort_array(a), "|")
    return rows.select("contact_id", status.alias("status"), F.coalesce("merged_from", F.lit("")).alias("merged_from"), changed.alias("changed"), F.when(status == "Held", joined(holds)).otherwise("").alias("hold_flags"), joined(F.filter("quality_flags", lambda f: ~f.isin(*blocking))).alias("information"))
