"""Policy rules as data: expectation clocks for any number of rules, the coverage gate that holds them, and retention of observations.

Observations are (account_id, object_type, record_id, at, properties: map of texts, coverage: array of what could not be read). Rules are
(rule_id, object_type, when_field, when_values: array, required_field, deadline_minutes): while a record's when_field has one of the values and its required field
is blank, a clock runs; once it has run for the deadline, the expectation is due.

Defined cases: a field that a record doesn't have is unknown, not blank: such an observation moves no clock and is told by ``unevaluable``; observations of one
time that disagree are unknown too; null properties are none; repeated observations count once; rules without values never qualify; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import ranked

#: Rules are broadcast if they are so few.
RULES = 10_000


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(RULES + 1).count() <= RULES else rules


def coverage(checks: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """(account_id, status, phase, gaps, records, last_checked_at) of each account's last check (account_id, at, status: healthy or degraded, phase: baseline or changes, stale_after_seconds).

    Saved records whose last observation could not be read whole (gaps) degrade an account whatever its check says; a check older than its limit is stale; a healthy baseline is baseline."""
    last = checks.groupBy("account_id").agg(F.max(F.struct("at", "status", "phase", "stale_after_seconds")).alias("c"))
    newest = observations.groupBy("account_id", "object_type", "record_id").agg(F.max(F.struct("at", F.size(F.coalesce("coverage", F.array().cast("array<string>"))).alias("n"))).alias("o"))
    gaps = newest.groupBy("account_id").agg(F.count_if(F.col("o.n") > 0).alias("gaps"), F.count("*").alias("records"))
    rows = last.join(gaps, "account_id", "left").select("account_id", "c.*", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("records", F.lit(0)).alias("records"))
    late = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) > F.coalesce("stale_after_seconds", F.lit(900)) * 1_000_000
    status = F.when(late, "stale").when((F.col("status") == "degraded") | (F.col("gaps") > 0), "degraded").when(F.col("phase") == "baseline", "baseline").otherwise("healthy")
    return rows.select("account_id", status.alias("status"), "phase", "gaps", "records", F.col("at").alias("last_checked_at"))


def _judged(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Every observation under every rule of its type: unmet, met or null (unknown), and what is missing."""
    rules = _small(rules.withColumnRenamed("object_type", "__type"))
    rows = observations.join(rules, F.col("object_type") == F.col("__type"))
    has = lambda c: F.coalesce(F.map_contains_key("properties", F.col(c)), F.lit(False))
    value = lambda c: F.coalesce(F.try_element_at("properties", F.col(c)), F.lit(""))
    asked = F.coalesce(F.array_contains("when_values", value("when_field")), F.lit(False))
    missing = F.array_compact(F.array(F.when(~has("when_field"), F.col("when_field")), F.when(asked & ~has("required_field"), F.col("required_field"))))
    return rows.select("account_id", "object_type", "record_id", "at", "rule_id", "required_field", "deadline_minutes", missing.alias("missing"), F.when(F.size(missing) == 0, asked & (F.trim(value("required_field")) == "")).alias("unmet"))


def unevaluable(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """(account_id, object_type, record_id, rule_id, missing) of the rules that a record's last observation can't answer."""
    last = _judged(observations, rules).groupBy("account_id", "object_type", "record_id", "rule_id").agg(F.max(F.struct("at", "missing")).alias("l"))
    return last.where(F.size("l.missing") > 0).select("account_id", "object_type", "record_id", "rule_id", F.array_join("l.missing", "|").alias("missing"))


def clocks(observations: DataFrame, rules: DataFrame, plans: DataFrame, gate: DataFrame, as_of: Column) -> DataFrame:
    """(account_id, object_type, record_id, rule_id, since, due_at, state) of every clock that runs: waiting, due, planned (a change (object_type, field, until) of the required field is under way) or gated (its account's coverage, as of ``coverage``, is not healthy or no baseline is complete)."""
    key = ["account_id", "object_type", "record_id", "rule_id"]
    rows = _judged(observations, rules).where("unmet IS NOT NULL").groupBy(*key, "at").agg(F.max("unmet").alias("unmet"), (F.min("unmet") != F.max("unmet")).alias("torn"), F.first("required_field").alias("field"), F.first("deadline_minutes").alias("minutes")).where("NOT torn")
    met = rows.groupBy(*key).agg(F.max(F.when(~F.col("unmet"), F.col("at"))).alias("met"))
    null_safe = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key]
    open_ = rows.where("unmet").alias("r").join(met.alias("m"), null_safe).where("met IS NULL OR at > met").groupBy(*(f"r.{c}" for c in key)).agg(F.min("at").alias("since"), F.first("field").alias("field"), F.first("minutes").alias("minutes"))
    busy = plans.where(F.col("until") > as_of).select(F.col("object_type").alias("p_type"), F.col("field").alias("p_field")).distinct()
    good = gate.where("status = 'healthy' AND phase = 'changes'").select(F.col("account_id").alias("g_account")).distinct()
    rows = open_.join(busy, (F.col("object_type") == F.col("p_type")) & (F.col("field") == F.col("p_field")), "left").join(good, F.col("account_id") == F.col("g_account"), "left")
    due_at = F.col("since") + F.make_dt_interval(mins=F.col("minutes").cast("int"))
    state = F.when(due_at > as_of, "waiting").when(F.col("g_account").isNull(), "gated").when(F.col("p_type").isNotNull(), "planned").otherwise("due")
    return rows.select(*key, "since", due_at.alias("due_at"), state.alias("state"))


def retained(observations: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """Observations that each account's policy (account_id, retention_days, most) keeps: no older than its days, and the newest so many of those; accounts without a policy keep all. Ties fall to the later record id."""
    p = policies.select(F.col("account_id").alias("p_account"), "retention_days", "most")
    rows = observations.join(_small(p), F.col("account_id") == F.col("p_account"), "left")
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    fresh = rows.where(F.col("retention_days").isNull() | (age <= F.col("retention_days") * 86_400_000_000))
    return ranked(fresh, ["account_id"], [F.desc("at"), F.desc("record_id")], "__n").where(F.col("most").isNull() | (F.col("__n") <= F.col("most"))).select(*observations.columns)
