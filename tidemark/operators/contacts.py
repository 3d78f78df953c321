"""Contact audit flags, readiness, repairs, corrections and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Flags that keep a contact from a destination, and stages in order of rank.
BLOCKING = ("invalid_email", "duplicate_identity", "missing_company", "missing_owner", "stage_regression")
STAGES = ("lead", "mql", "sql", "opportunity", "closed_won")


def rank(stage: Column) -> Column:
    return F.coalesce(*(F.when(stage == s, F.lit(i + 1)) for i, s in enumerate(STAGES)), F.lit(0))


def _flag_list(**conditions: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())))


def with_duplicates(df: DataFrame) -> DataFrame:
    """quality_flags with duplicate_identity set anew: active, not excluded rows that share a normal email. Counts are summed before the join, so a common email is no hot window."""
    counted = (F.col("record_status") == "active") & ~F.col("excluded") & F.col("normalized_email").isNotNull()
    shared = df.where(counted).groupBy(F.col("normalized_email").alias("__e")).count().where("count > 1").select("__e", F.lit(True).alias("__shared"))
    out = df.join(shared, df["normalized_email"] == F.col("__e"), "left")
    others = F.array_remove("quality_flags", "duplicate_identity")
    return out.withColumn("quality_flags", F.when(counted & F.coalesce("__shared", F.lit(False)), F.array_append(others, F.lit("duplicate_identity"))).otherwise(others)).drop("__e", "__shared")


def flagged(contacts: DataFrame) -> DataFrame:
    """Raw contacts with normalized_email, excluded and quality_flags."""
    out = contacts if "normalized_email" in contacts.columns else contacts.withColumn("normalized_email", T.email(F.col("raw_email")))
    if "excluded" not in out.columns:
        out = out.withColumn("excluded", F.lit(False))
    stage, expected = rank(T.stage(F.col("lifecycle_stage"))), rank(T.stage(F.col("expected_lifecycle_stage")))
    blank = lambda c: F.coalesce(T.trimmed(F.col(c)), F.lit("")) == ""
    own = _flag_list(
        invalid_email=F.col("normalized_email").isNull(),
        missing_company=blank("company"),
        missing_owner=blank("owner_id"),
        plus_address_present=F.substring_index(F.col("raw_email"), "@", 1).contains("+"),
        unicode_domain_present=F.substring_index(F.col("raw_email"), "@", -1).rlike(r"[^\x00-\x7F]"),
        stage_regression=stage < expected,
    )
    supplied = F.col("quality_flags") if "quality_flags" in out.columns else F.array().cast("array<string>")
    return with_duplicates(out.withColumn("quality_flags", F.array_distinct(F.concat(own, supplied))))


def is_ready(blocking: tuple[str, ...] = BLOCKING) -> Column:
    return (F.col("record_status") == "active") & ~F.col("excluded") & ~F.arrays_overlap("quality_flags", F.array(*map(F.lit, blocking)))


def audit(df: DataFrame) -> DataFrame:
    """One row of counters, readiness and its label over flagged contacts."""
    active = (F.col("record_status") == "active") & ~F.col("excluded")
    has = lambda f: F.count_if(active & F.array_contains("quality_flags", f))
    names = (*BLOCKING, "plus_address_present", "unicode_domain_present")
    dup = F.countDistinct(F.when(active & F.array_contains("quality_flags", "duplicate_identity"), F.col("normalized_email")))
    out = df.agg(F.count("*").alias("rows"), F.count_if(active).alias("active"), F.count_if(is_ready()).alias("ready"), *(has(f).alias(f"n_{f}") for f in names), dup.alias("duplicate_groups"))
    out = out.withColumn("readiness", F.when(F.col("active") == 0, 0).otherwise(F.floor(F.col("ready") * 100.0 / F.col("active") + 0.5)).cast("long"))
    label = F.when(F.col("readiness") >= 90, "Ready").when(F.col("readiness") >= 70, "Needs cleanup").when(F.col("readiness") >= 40, "At risk").otherwise("Blocked")
    return out.withColumn("label", label).withColumn("automatable", F.col("n_duplicate_identity") - F.col("duplicate_groups") + F.col("n_stage_regression"))


def priorities(df: DataFrame) -> DataFrame:
    """Flags of active contacts with their counts, blocking ones first, then the commonest."""
    rows = df.where((F.col("record_status") == "active") & ~F.col("excluded")).select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return rows.withColumn("blocking", F.col("flag").isin(*BLOCKING)).orderBy(F.desc("blocking"), F.desc("n"), "flag")


def merge(df: DataFrame) -> DataFrame:
    """Active rows of one email merged into the canonical one: a clean raw spelling first, then the smallest id. Only the smallest such pair per email is joined back."""
    live = (F.col("record_status") == "active") & ~F.col("excluded") & F.col("normalized_email").isNotNull()
    unclean = (F.col("raw_email") != F.lower(T.trimmed(F.col("raw_email")))).cast("int")
    groups = df.where(live).groupBy(F.col("normalized_email").alias("__e")).agg(F.min(F.struct(unclean.alias("u"), F.col("contact_id").alias("id"))).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    out = df.join(groups, df["normalized_email"] == F.col("__e"), "left")
    mine = live & F.col("__n").isNotNull()
    other = mine & (F.col("contact_id") != F.col("__first.id"))
    return out.withColumns(
        {
            "canonical_contact_id": F.when(mine, F.col("__first.id")),
            "record_status": F.when(other, "merged").otherwise(F.col("record_status")),
            "quality_flags": F.when(mine & ~other, F.array_remove("quality_flags", "duplicate_identity")).otherwise(F.col("quality_flags")),
            "last_action": F.when(other, "merge").otherwise(F.lit(None).cast("string")),
        }
    ).drop("__e", "__first", "__n")


def reroute(df: DataFrame, region: str = "northeast", segment: str = "enterprise", overflow: str = "NE-ENT-OVERFLOW") -> DataFrame:
    """Active rows of a region and segment handed to the overflow owner."""
    hit = (F.col("record_status") == "active") & ~F.col("excluded") & (F.lower("region") == region) & (F.lower("segment") == segment) & (F.coalesce("owner_id", F.lit("")) != overflow)
    return df.withColumns({"owner_id": F.when(hit, overflow).otherwise(F.col("owner_id")), "quality_flags": F.when(hit, F.array_remove("quality_flags", "missing_owner")).otherwise(F.col("quality_flags")), "last_action": F.when(hit, "reroute").otherwise(F.lit(None).cast("string"))})


def replay(df: DataFrame) -> DataFrame:
    """Regressed stages set to the expected one."""
    hit = (F.col("record_status") == "active") & ~F.col("excluded") & F.array_contains("quality_flags", "stage_regression")
    return df.withColumns({"lifecycle_stage": F.when(hit, F.col("expected_lifecycle_stage")).otherwise(F.col("lifecycle_stage")), "quality_flags": F.when(hit, F.array_remove("quality_flags", "stage_regression")).otherwise(F.col("quality_flags")), "last_action": F.when(hit, "replay").otherwise(F.lit(None).cast("string"))})


REPAIRS = {"merge": merge, "reroute": reroute, "replay": replay}


def repair(df: DataFrame, scenario: str) -> DataFrame:
    """The named repair; ValueError for another name. Rows with last_action set are those it changed."""
    if scenario not in REPAIRS:
        raise ValueError(f"unknown scenario {scenario!r}")
    return REPAIRS[scenario](df)


def warehouse_merge(df: DataFrame) -> DataFrame:
    """The warehouse's variant: rows flagged as duplicates are merged into the canonical one among all flagged rows of their email, whatever their status; the flag then goes from every active row."""
    dup = F.col("normalized_email").isNotNull() & F.array_contains("quality_flags", "duplicate_identity")
    unclean = (F.col("raw_email") != F.lower(F.trim("raw_email"))).cast("int")
    first = df.where(dup).groupBy(F.col("normalized_email").alias("__e")).agg(F.min(F.struct(unclean.alias("u"), F.col("contact_id").alias("id"))).alias("__first"))
    out = df.join(first, dup & (F.col("normalized_email") == F.col("__e")), "left")
    active = F.col("record_status") == "active"
    other = active & (F.col("__first.id") != F.col("contact_id"))
    kept = active & ~F.coalesce(other, F.lit(False)) & F.array_contains("quality_flags", "duplicate_identity")
    none = F.lit(None).cast("string")
    return out.withColumns(
        {
            "canonical_contact_id": F.when(other, F.col("__first.id")).otherwise(F.col("canonical_contact_id") if "canonical_contact_id" in df.columns else none),
            "record_status": F.when(other, "merged").otherwise(F.col("record_status")),
            "quality_flags": F.when(kept, F.array_remove("quality_flags", "duplicate_identity")).otherwise(F.col("quality_flags")),
            "last_action": F.when(other, "merged_into_canonical").when(kept, "canonical_record_retained").otherwise(none),
        }
    ).drop("__e", "__first")


def warehouse_reroute(df: DataFrame) -> DataFrame:
    """Active rows of one owner's overloaded territory handed to the overflow owner; flags stay."""
    hit = (F.col("record_status") == "active") & (F.col("region") == "Northeast") & (F.col("segment") == "Enterprise") & (F.col("owner_id") == OVERLOADED)
    return df.withColumns({"owner_id": F.when(hit, OVERFLOW).otherwise(F.col("owner_id")), "last_action": F.when(hit, "rerouted_from_ne_enterprise").otherwise(F.lit(None).cast("string"))})


def warehouse_replay(df: DataFrame) -> DataFrame:
    """Active rows flagged with a regressed stage get the expected one, excluded rows too."""
    hit = (F.col("record_status") == "active") & F.array_contains("quality_flags", "stage_regression")
    return df.withColumns({"lifecycle_stage": F.when(hit, F.col("expected_lifecycle_stage")).otherwise(F.col("lifecycle_stage")), "quality_flags": F.when(hit, F.array_remove("quality_flags", "stage_regression")).otherwise(F.col("quality_flags")), "last_action": F.when(hit, "lifecycle_replayed").otherwise(F.lit(None).cast("string"))})


# The warehouse's scenarios, the actions that count as rows affected, and the owners of its territory.
WAREHOUSE = {"duplicate-surge": (warehouse_merge, "merged_into_canonical"), "routing-overload": (warehouse_reroute, "rerouted_from_ne_enterprise"), "stage-regression": (warehouse_replay, "lifecycle_replayed")}
OVERLOADED, OVERFLOW = "NE-ENT", "CE-ENT-OVERFLOW"


def warehouse_repair(df: DataFrame, scenario: str, action: str, request_id: str, at: str) -> dict[str, DataFrame]:
    """The scenario's new state, with one row each for the run log, the event log and the receipt; ValueError for another scenario. Approved at the time given."""
    if scenario not in WAREHOUSE:
        raise ValueError(f"unknown scenario {scenario!r}")
    fix, counted = WAREHOUSE[scenario]
    state = fix(df)
    affected = state.agg(F.count_if(F.col("last_action") == counted).alias("affected_records"))
    when, event = F.lit(at).cast("timestamp_ntz"), F.lit(f"REPAIR-{scenario}-{request_id}")
    text = lambda v, name: F.lit(v).alias(name)
    run = affected.select(text(request_id, "run_id"), text(scenario, "scenario"), text(action, "action"), text("executed", "status"), "affected_records", when.alias("started_at"), when.alias("finished_at"))
    log = affected.select(event.alias("event_id"), text("CONTROL-TOWER", "lead_id"), text("SYSTEM", "account_id"), text(f"repair_executed_{scenario}", "event_type"), text("lead", "lifecycle_stage"), when.alias("event_timestamp"), text("control_tower", "source"), text(scenario, "region"), text("System", "segment"), text("CONTROL-TOWER", "owner_id"), F.lit(0).alias("route_seconds"), F.lit(False).alias("is_duplicate"))
    receipt = affected.select(F.lit(True).alias("accepted"), text("executed", "status"), text(scenario, "scenario"), text(action, "action"), text(request_id, "request_id"), event.alias("event_id"), "affected_records", when.alias("approved_at"))
    return {"state": state, "run": run, "event": log, "receipt": receipt}


def exclude(df: DataFrame, rows: DataFrame, excluded: bool = True) -> DataFrame:
    """Contacts named in rows (contact_id) excluded or restored; duplicates are set anew."""
    ids = rows.select(F.col("contact_id").alias("__id")).distinct()
    out = df.join(ids, df["contact_id"] == F.col("__id"), "left")
    return with_duplicates(out.withColumn("excluded", F.when(F.col("__id").isNotNull(), F.lit(excluded)).otherwise(F.col("excluded"))).drop("__id"))


def correct(df: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (contact_id, then any of raw_email, company, owner_id; null: as it was) applied; the flags of patched rows are made anew."""
    fields = [c for c in ("raw_email", "company", "owner_id") if c in patches.columns]
    p = patches.select(F.col("contact_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in fields))
    out = df.join(p, df["contact_id"] == F.col("__id"), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in fields})
    return flagged(out.drop("__id", "normalized_email", "quality_flags", *(f"__{c}" for c in fields)))


def stage_funnel(df: DataFrame) -> DataFrame:
    """Active contacts at or beyond each stage."""
    active = df.where((F.col("record_status") == "active") & ~F.col("excluded"))
    counts = active.agg(*(F.count_if(rank(F.col("lifecycle_stage")) >= i + 1).alias(s) for i, s in enumerate(STAGES)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in STAGES))).alias("x")).select("x.*")
