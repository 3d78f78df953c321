"""Change detection and incident detectors over record observations (record_id, field, value, at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Forms of a deal's amount and of its close date.
AMOUNT, CLOSE_DATE = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$", r"^\d{4}-\d{2}-\d{2}(?:T.*)?$"
# Window in seconds, least records, least share, least reversals of an incident.
WINDOW_SECONDS, LEAST_RECORDS, LEAST_SHARE, REVERSALS = 1800, 10, 0.2, 3


def _at_once(observations: DataFrame) -> DataFrame:
    """(record_id, field, at, after, ambiguous): what was seen at one time, repeated deliveries once."""
    v = F.coalesce("value", F.lit("\x00"))
    return observations.groupBy("record_id", "field", "at").agg(F.max("value").alias("after"), (F.min(v) != F.max(v)).alias("ambiguous"))


def changes(observations: DataFrame) -> DataFrame:
    """(record_id, field, before, after, at): values that differ from the last one seen; first values are a baseline. Repeated deliveries count once; times with two values have no winner and change nothing (see ``ambiguous``)."""
    w = Window.partitionBy("record_id", "field").orderBy("at")
    seen = _at_once(observations).where("NOT ambiguous").withColumns({"before": F.lag("after").over(w), "n": F.row_number().over(w)})
    return seen.where((F.col("n") > 1) & ~F.col("before").eqNullSafe(F.col("after"))).select("record_id", "field", "before", "after", "at")


def ambiguous(observations: DataFrame) -> DataFrame:
    """(record_id, field, at) of values that conflict at one time: a coverage incident, not a change."""
    return _at_once(observations).where("ambiguous").select("record_id", "field", "at")


def unplanned(found: DataFrame, plans: DataFrame) -> DataFrame:
    """Changes of fields without a planned change (field, until) that still runs at their time."""
    p = plans.groupBy(F.col("field").alias("__f")).agg(F.max("until").alias("__u"))
    return found.join(p, (F.col("field") == F.col("__f")) & (F.col("at") < F.col("__u")), "left_anti")


def bulk_clears(found: DataFrame, population: DataFrame, seconds: int = WINDOW_SECONDS, least: int = LEAST_RECORDS, share: float = LEAST_SHARE) -> DataFrame:
    """(field, at, records, share): times at which many distinct records lost their value in the window that ends there. population: (field, records).

    A record counts from its clear to the window's end or its next clear, so the count at a time is a running sum of such starts and ends. The sums run inside
    slots of the window's length, from what each field's earlier slots sum to, so no field is one sorted run."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    t = F.unix_micros(F.col("at").cast("timestamp"))
    gone = found.where(blank("after") & ~blank("before")).select("field", "record_id", "at", t.alias("t"))
    later = F.lead("t").over(Window.partitionBy("field", "record_id").orderBy("t"))
    end = F.least(F.col("t") + seconds * 1_000_000 + 1, F.coalesce("later", F.col("t") + seconds * 1_000_000 + 1))
    step = lambda when, d, at: F.struct(when.alias("t"), F.lit(d).alias("d"), at.alias("at"))
    steps = gone.withColumn("later", later).select("field", F.explode(F.array(step(F.col("t"), 1, F.col("at")), step(end, -1, F.lit(None).cast(gone.schema["at"].dataType)))).alias("s"))
    steps = steps.groupBy("field", F.col("s.t").alias("t")).agg(F.sum("s.d").alias("d"), F.max("s.at").alias("at")).withColumn("slot", F.floor(F.col("t") / (seconds * 1_000_000)))
    upto = Window.partitionBy("field").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = steps.groupBy("field", "slot").agg(F.sum("d").alias("d")).select("field", "slot", F.coalesce(F.sum("d").over(upto), F.lit(0)).alias("held"))
    inside = Window.partitionBy("field", "slot").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    counts = steps.withColumn("inside", F.sum("d").over(inside)).where("at IS NOT NULL").join(slots, ["field", "slot"])
    out = counts.withColumn("records", F.col("held") + F.col("inside")).join(population.withColumnRenamed("records", "population"), "field").withColumn("share", F.round(F.col("records") / F.col("population"), 6))
    return out.where((F.col("records") >= least) & (F.col("share") >= share)).select("field", "at", "records", "share")


def reversals(found: DataFrame, least: int = REVERSALS, hours: int = 24) -> DataFrame:
    """Records and fields whose value went back to what it was, often, within a day before a change. Changes between the same two values meet, and those of the other direction are counted."""
    key = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    rows = found.withColumns({"lo": F.least(key("before"), key("after")), "hi": F.greatest(key("before"), key("after")), "up": (key("before") < key("after")).cast("int")})
    w = Window.partitionBy("record_id", "field", "lo", "hi").orderBy(F.unix_seconds(F.col("at").cast("timestamp"))).rangeBetween(-hours * 3600, 0)
    n = F.when(F.col("up") == 1, F.sum(1 - F.col("up")).over(w)).otherwise(F.sum("up").over(w))
    return rows.withColumn("n", n).where(F.col("n") >= least).groupBy("record_id", "field").agg(F.max("n").alias("reversals"), F.min("at").alias("first_at"))


def expectations_due(states: DataFrame, values: tuple[str, ...], deadline_minutes: int, as_of: str) -> DataFrame:
    """(record_id, since): records whose last state (record_id, at, condition, required) has a condition among the values and a blank required field, unmet since the first such state after the last one that met it, and past the deadline."""
    blank = F.trim(F.coalesce("required", F.lit(""))) == ""
    rows = states.withColumn("unmet", F.coalesce(F.col("condition").isin(*values), F.lit(False)) & blank)
    met = rows.groupBy("record_id").agg(F.max(F.when(~F.col("unmet"), F.col("at"))).alias("met"))
    open_ = rows.where("unmet").join(met, "record_id").where("met IS NULL OR at > met").groupBy("record_id").agg(F.min("at").alias("since"))
    return open_.where(F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) >= deadline_minutes * 60)


def grouped(detections: DataFrame) -> DataFrame:
    """One incident per fingerprint of detections (kind, object_type, field, record_id, at): its records, first and last time."""
    mark = F.concat_ws(":", "kind", "object_type", "field").alias("fingerprint")
    return detections.groupBy(mark).agg(F.countDistinct("record_id").alias("records"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def timeline(old: DataFrame, new: DataFrame, least: int = LEAST_RECORDS) -> DataFrame:
    """(fingerprint, version, status, records, event): incidents (fingerprint, version, status, records) after new groups: found again counts the version up and opens a resolved one; its event is detected, reopened or scope_expanded (records doubled over the least), else null."""
    o = old.select("fingerprint", "version", F.col("status").alias("was"), F.col("records").alias("had"))
    rows = new.select("fingerprint", "records").join(o, "fingerprint", "full_outer")
    power = lambda c: F.floor(F.log2(c / F.lit(least)))
    grew = (F.col("records") > F.col("had")) & (power(F.col("records")) > power(F.greatest(F.lit(least), F.col("had"))))
    event = F.when(F.col("records").isNull(), None).when(F.col("was").isNull(), "detected").when(F.col("was") == "resolved", "reopened").when(grew, "scope_expanded")
    version = F.when(F.col("records").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    status = F.when(F.col("records").isNull() | ((F.col("was") != "resolved") & F.col("was").isNotNull()), F.col("was")).otherwise("open")
    return rows.select("fingerprint", version.cast("long").alias("version"), status.alias("status"), F.greatest(F.coalesce("records", F.lit(0)), F.coalesce("had", F.lit(0))).cast("long").alias("records"), event.alias("event"))


def invalid_deals(deals: DataFrame, no_negative: bool = False) -> DataFrame:
    """(record_id, field) of deals (record_id, amount, close_date, as texts) whose amount is no number or whose date is no calendar date; blanks pass."""
    amount, close = F.trim("amount"), F.col("close_date")
    number = amount.rlike(AMOUNT)
    bad_amount = (amount != "") & (~number | (F.lit(no_negative) & (F.try_to_number(amount, F.lit("S9999999999999999.9999")) < 0)))
    day = F.substring(close, 1, 10)
    bad_close = (F.trim(close) != "") & (~close.rlike(CLOSE_DATE) | F.try_to_date(day, "yyyy-MM-dd").isNull())
    return deals.select("record_id", F.explode(F.array_compact(F.array(F.when(bad_amount, F.lit("amount")), F.when(bad_close, F.lit("close_date"))))).alias("field"))


def field_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, added, absent): property names that two snapshots (record_id, properties: map) of a record don't share. Absent ones are lost coverage, never cleared values."""
    a = after.select("record_id", F.map_keys("properties").alias("now"))
    rows = before.select("record_id", F.map_keys("properties").alias("was")).join(a, "record_id")
    return rows.select("record_id", F.array_sort(F.array_except("now", "was")).alias("added"), F.array_sort(F.array_except("was", "now")).alias("absent")).where("size(added) > 0 OR size(absent) > 0")


def relationship_ids(value: Column) -> Column:
    """Blank: none; a scalar: itself; a JSON array of at most 200 texts: each once; null for what is neither."""
    listed = F.from_json(value, "array<string>")
    trimmed = F.trim(value)
    return F.when(trimmed == "", F.array().cast("array<string>")).when(~trimmed.startswith("["), F.array(trimmed)).when(listed.isNotNull() & (F.size(listed) <= 200) & ~F.exists(listed, lambda x: x.isNull() | (F.trim(x) == "")), F.array_distinct(listed))


def activity_drop(events: DataFrame, as_of: str, hours: int = 24, least: int = 10) -> DataFrame:
    """Kinds that were active in the window before the last one and silent in it."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))
    recent, before = (age >= 0) & (age < hours * 3600), (age >= hours * 3600) & (age < 2 * hours * 3600)
    per = events.groupBy("kind").agg(F.countDistinct(F.when(recent, F.col("record_id"))).alias("recent"), F.countDistinct(F.when(before, F.col("record_id"))).alias("previous"))
    return per.where((F.col("recent") == 0) & (F.col("previous") >= least))


def broken_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (record_id, target_id) to records that don't exist."""
    return links.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_anti").select("record_id", "target_id")


def high_water(observations: DataFrame, stages: tuple[str, ...] = ("lead", "mql", "sql", "opportunity", "closed_won")) -> DataFrame:
    """(record_id, at, rank, high, regressed): running greatest stage rank, begun anew after a value that has none."""
    rank = F.coalesce(*(F.when(F.col("value") == s, F.lit(i + 1)) for i, s in enumerate(stages)), F.lit(None).cast("int"))
    w = Window.partitionBy("record_id").orderBy("at", "value")
    rows = observations.withColumn("rank", rank).withColumn("run", F.sum(F.col("rank").isNull().cast("int")).over(w))
    upto = Window.partitionBy("record_id", "run").orderBy("at", "value").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("high", F.when(F.col("rank").isNotNull(), F.max("rank").over(upto)))
    return rows.select("record_id", "at", "value", "rank", "high", F.coalesce(F.col("rank") < F.col("high"), F.lit(False)).alias("regressed"))


def notices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incidents (key, status, records) to tell of: new, reopened, or grown by a power of two of the least records."""
    step = lambda c: F.floor(F.log2(F.greatest(F.col(c), F.lit(1)) / LEAST_RECORDS))
    o = old.select("key", F.col("status").alias("was"), F.col("records").alias("had"))
    rows = new.join(o, "key", "left")
    why = F.when(F.col("was").isNull(), "new").when((F.col("was") != "open") & (F.col("status") == "open"), "reopened").when(step("records") > step("had"), "grown")
    return rows.withColumn("why", why).where("why IS NOT NULL").select("key", "why", "records")
