"""Rules over monitored people: missing and invalid emails, owners, stages that moved back, white space around texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Stages in order, those that need an owner, objects that the rules are for.
ORDERED = ("subscriber", "lead", "marketingqualifiedlead", "salesqualifiedlead", "opportunity", "customer", "evangelist")
OWNED = ("salesqualifiedlead", "opportunity", "customer")
PEOPLE = ("Lead", "Contact")


def _rank(stage: Column) -> Column:
    return F.coalesce(*(F.when(stage == s, F.lit(i)) for i, s in enumerate(ORDERED)), F.lit(-1))


def _stages(records: DataFrame, previous: DataFrame) -> DataFrame:
    """records with the high water of before, and the ranks of both."""
    rows = records.join(previous.select("record_id", F.col("high_water").alias("__high")), "record_id", "left")
    now = F.when(F.col("provider") == "salesforce", F.lit(-1)).otherwise(_rank(F.col("props")["lifecyclestage"]))
    return rows.withColumns({"__now": now, "__was": _rank(F.col("__high"))})


def issues(records: DataFrame, previous: DataFrame) -> DataFrame:
    """(record_id, rule, severity, before, after) of records (record_id, provider, object_type, props: a map); before and after are maps of the fields concerned. previous: (record_id, high_water).

    A property that is not there says nothing, a blank one does. Objects other than leads and contacts have no issues."""
    p = F.col("props")
    has = lambda k: F.map_contains_key("props", F.lit(k))
    mail, owner, stage = p["email"], F.trim(F.coalesce(p["hubspot_owner_id"], F.lit(""))), p["lifecyclestage"]
    sales = F.col("provider") == "salesforce"
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    pairs = lambda *kv: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in kv))
    issue = lambda rule, severity, before, after: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), before.alias("before"), after.alias("after"))
    texts = F.when(sales & (F.col("object_type") == "Contact"), F.array(F.lit("jobtitle"))).otherwise(F.array(F.lit("company"), F.lit("jobtitle")))
    untrimmed = F.map_filter("props", lambda k, v: F.array_contains(texts, k) & (v != T.trimmed(v)))
    blank = T.trimmed(F.coalesce(mail, F.lit(""))) == ""
    rules = [
        F.when(has("email") & blank, issue("email_missing", "critical", pairs("email", F.coalesce(mail, F.lit(""))), nothing)),
        F.when(has("email") & ~blank & ~T.email_plausible(mail), issue("email_invalid", "critical", pairs("email", mail), nothing)),
        F.when(~sales & has("hubspot_owner_id") & stage.isin(*OWNED) & (owner == ""), issue("owner_missing", "warning", pairs("lifecyclestage", stage, "hubspot_owner_id", F.coalesce(p["hubspot_owner_id"], F.lit(""))), nothing)),
        F.when((F.col("__now") >= 0) & (F.col("__was") >= 0) & (F.col("__now") < F.col("__was")), issue("lifecycle_regression", "critical", pairs("lifecyclestage", F.col("__high")), pairs("lifecyclestage", stage))),
        F.when(F.size(untrimmed) > 0, issue("text_whitespace", "warning", untrimmed, F.transform_values(untrimmed, lambda _, v: T.trimmed(v)))),
    ]
    people = _stages(records, previous).where(F.coalesce(F.col("object_type").isin(*PEOPLE), F.lit(True)))
    return people.select("record_id", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("record_id", "i.*")


def high_waters(records: DataFrame, previous: DataFrame) -> DataFrame:
    """(record_id, high_water) after records: the higher of both stages; none where the new one has no rank or the object is no person."""
    stage = F.col("props")["lifecyclestage"]
    high = F.when(F.coalesce(F.col("object_type").isin(*PEOPLE), F.lit(True)) & (F.col("__now") >= 0), F.when(F.col("__was") > F.col("__now"), F.col("__high")).otherwise(stage))
    return _stages(records, previous).select("record_id", high.alias("high_water"))
