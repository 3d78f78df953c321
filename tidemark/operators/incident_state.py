"""Incidents over time, rebuilt in batch: members, history and silences. ``tidemark.streaming.incident_state`` has the same as streams.

A detection (kind, object_type, field, record_id, at) belongs to the incident of its fingerprint; those of one time are one pass, whose
records are counted once. A record joins an incident with its first detection and stays. Resolutions are rows (fingerprint, at); at one time they
come after detections. Null record ids are detections without a record (of an account as a whole), null fingerprint parts are left out of the
fingerprint, rows without a time are left out; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.incidents import LEAST_RECORDS, relationship_ids

SLOT = "day"
# Fields that name related records with the objects they name, newest members of an incident whose relations are read, and related records of an incident.
RELATIONS = {"company_id": "Company", "company_ids": "Company", "account_id": "Account", "contact_ids": "Contact"}
NEWEST, RELATED = 50, 30


def fingerprinted(detections: DataFrame) -> DataFrame:
    """(fingerprint, record_id, at)."""
    return detections.where("at IS NOT NULL").select(F.concat_ws(":", "kind", "object_type", "field").alias("fingerprint"), "record_id", "at")


def members(detections: DataFrame) -> DataFrame:
    """(fingerprint, record_id, first_at, last_at, passes) of every record of every incident."""
    rows = fingerprinted(detections).where("record_id IS NOT NULL")
    return rows.groupBy("fingerprint", "record_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.countDistinct("at").alias("passes"))


def grown(records: Column, had: Column, least: int) -> Column:
    """Whether a pass's records pass a further power of two of the least over the members before."""
    power = lambda c: F.floor(F.log2(c / F.lit(float(least))))
    return F.coalesce((records > had) & (power(records) > power(F.greatest(F.lit(least), had))), F.lit(False))


def history(detections: DataFrame, resolutions: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """(fingerprint, at, version, records, members, event) of every pass: event is detected, reopened (after a resolution), scope_expanded, or null.

    Sums run inside a fingerprint's days, from what its earlier days sum to, so an incident that holds most passes is many sorted runs, not one."""
    rows = fingerprinted(detections)
    passes = rows.groupBy("fingerprint", "at").agg(F.countDistinct("record_id").alias("records"))
    firsts = rows.where("record_id IS NOT NULL").groupBy("fingerprint", "record_id").agg(F.min("at").alias("at")).groupBy("fingerprint", "at").agg(F.count("*").alias("joined"))
    passes = passes.join(firsts, ["fingerprint", "at"], "left").select("fingerprint", "at", F.lit(0).alias("resolved"), "records", F.coalesce("joined", F.lit(0)).alias("joined"))
    ends = resolutions.where("at IS NOT NULL").select("fingerprint", "at", F.lit(1).alias("resolved"), F.lit(0).cast("long").alias("records"), F.lit(0).cast("long").alias("joined")).distinct()
    steps = passes.unionByName(ends).withColumn("slot", F.date_trunc(SLOT, F.col("at")))
    upto = Window.partitionBy("fingerprint").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = steps.groupBy("fingerprint", "slot").agg(F.sum("joined").alias("joined"), F.count_if(F.col("resolved") == 0).alias("passes"), F.max(F.struct("at", "resolved")).alias("end"))
    slots = slots.select("fingerprint", "slot", F.coalesce(F.sum("joined").over(upto), F.lit(0)).alias("had"), F.coalesce(F.sum("passes").over(upto), F.lit(0)).alias("earlier"), F.last("end").over(upto)["resolved"].alias("left"))
    within = Window.partitionBy("fingerprint", "slot").orderBy("at", "resolved")
    sofar = within.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag("resolved").over(within), F.col("left"))
    rows = steps.join(slots, ["fingerprint", "slot"]).withColumns({"before": before, "members": F.col("had") + F.sum("joined").over(sofar), "version": F.col("earlier") + F.sum(1 - F.col("resolved")).over(sofar), "any": F.col("earlier") + F.sum(1 - F.col("resolved")).over(sofar) > 1})
    event = F.when(~F.col("any"), "detected").when(grown(F.col("records"), F.col("members") - F.col("joined"), least), "scope_expanded").when(F.col("before") == 1, "reopened")
    return rows.where("resolved = 0").select("fingerprint", "at", F.col("version").cast("long").alias("version"), "records", "members", event.alias("event"))


def silences(activity: DataFrame, minutes: int, as_of: Column, least: int = 1) -> DataFrame:
    """(account_id, last_at, records): times after which nothing came for so many minutes, if at least so many distinct records were active in as many minutes up to them.

    With least 1 and checks as activity these are the gaps of a monitor's heartbeat. activity: (account_id, record_id, at)."""
    micros = minutes * 60_000_000
    t = F.unix_micros(F.col("at").cast("timestamp"))
    rows = activity.where("at IS NOT NULL").withColumn("t", t)
    times = rows.select("account_id", "t", "at").distinct().withColumn("next", F.lead("t").over(Window.partitionBy("account_id").orderBy("t")))
    quiet = times.where(F.coalesce("next", F.unix_micros(as_of.cast("timestamp"))) > F.col("t") + micros).select("account_id", F.col("t").alias("end"), F.col("at").alias("last_at"))
    # quiet times of an account are further apart than the window, so a row counts for the next one at most: looked up by the slot that it or the next slot holds
    slot = lambda c: F.floor(c / micros)
    marks = quiet.select("account_id", "end", "last_at", F.explode(F.array(slot(F.col("end")), slot(F.col("end")) - 1)).alias("slot"))
    near = rows.withColumn("slot", slot(F.col("t"))).join(marks, ["account_id", "slot"]).where("t <= end").where(F.col("t") > F.col("end") - micros)
    return near.groupBy("account_id", "last_at").agg(F.countDistinct("record_id").alias("records")).where(F.col("records") >= least).select("account_id", "last_at", "records")


def related(incident_members: DataFrame, records: DataFrame) -> DataFrame:
    """(fingerprint, place, object_type, record_id, at) of the records related to each incident's newest members: the first RELATED ids that their fields name, those of them that were observed.

    incident_members: (fingerprint, record_id); records: (object_type, record_id, at, properties), one of each. Ids are taken from newer members first, then by record id, field and position; one that is
    named again keeps its first place. Values that are no ids name none. Both limits keep the first rows of each incident in each task before any meet, so no incident is sorted whole."""
    first = lambda order, most, rows: rows.withColumn("__n", F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))).where(F.col("__n") <= most)
    held = incident_members.select("fingerprint", F.col("record_id").alias("member")).distinct().join(records.select(F.col("record_id").alias("member"), F.col("object_type").alias("of"), "at", "properties"), "member")
    newest = first([F.desc("at"), F.asc("member"), F.asc("of")], NEWEST, held).drop("__n")
    each = F.array(*(F.struct(F.lit(i).alias("field"), F.lit(kind).alias("object_type"), F.coalesce(relationship_ids(F.coalesce(F.try_element_at("properties", F.lit(name)), F.lit(""))), F.array().cast("array<string>")).alias("ids")) for i, (name, kind) in enumerate(RELATIONS.items())))
    named = newest.select("fingerprint", "at", "member", "of", F.explode(each).alias("r")).select("fingerprint", F.col("at").alias("seen"), "member", "of", "r.field", "r.object_type", F.posexplode("r.ids").alias("nth", "record_id"))
    order = F.min(F.struct((-F.unix_micros(F.col("seen").cast("timestamp"))).alias("age"), "member", "of", "field", "nth"))
    ids = named.groupBy("fingerprint", "object_type", "record_id").agg(order.alias("order"))
    kept = first([F.asc("order")], RELATED, ids).withColumnRenamed("__n", "place")
    return kept.join(records.select("object_type", "record_id", "at"), ["object_type", "record_id"]).select("fingerprint", F.col("place").cast("int").alias("place"), "object_type", "record_id", "at")
