"""Event marts: staging with the latest version of each event, funnel, routing SLA, data quality, live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lifecycle stages in order, and the routing target in seconds.
STAGES = ("lead", "mql", "sql", "opportunity", "closed_won")
SLA_SECONDS = 120


def staged(events: DataFrame) -> DataFrame:
    """Trimmed lower-case text columns; the version of each event ingested last (ties: the greatest stage, then timestamp)."""
    clean = events.withColumns({c: F.lower(F.trim(c)) for c in ("event_type", "lifecycle_stage")}).withColumns({c: F.trim(c) for c in ("region", "segment")})
    # the greatest struct, so versions are dropped before the shuffle
    order = ("ingested_at", "lifecycle_stage", "event_timestamp")
    last = clean.groupBy("event_id").agg(F.max(F.struct(*order, *(c for c in clean.columns if c not in ("event_id", *order)))).alias("r"))
    return last.select(*(F.col("event_id") if c == "event_id" else F.col(f"r.{c}") for c in clean.columns))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def funnel(stage: DataFrame) -> DataFrame:
    """Distinct leads that reached each stage or a later one, and won revenue, by month, segment and region."""
    # each lead's furthest stage first: one pass, where distinct counts would expand every row once a stage
    rank = F.coalesce(*(F.when(F.col("lifecycle_stage") == s, F.lit(i)) for i, s in enumerate(STAGES)), F.lit(-1))
    keys = ("month", "segment", "region")
    won = F.when(F.col("lifecycle_stage") == STAGES[-1], F.col("opportunity_amount"))
    per = stage.withColumn("month", F.date_trunc("month", "event_timestamp").cast("date")).groupBy(*keys, "lead_id").agg(F.max(rank).alias("rank"), F.sum(won).alias("won"))
    reached = [F.count_if(F.col("lead_id").isNotNull() & (F.col("rank") >= i)).alias(f"{s}s") for i, s in enumerate(STAGES)]
    return per.groupBy(*keys).agg(*reached, F.coalesce(F.sum("won"), F.lit(0)).alias("won_revenue"))


def routing_sla(stage: DataFrame, event_type: str = "lifecycle_changed", seconds: int = SLA_SECONDS) -> DataFrame:
    """Routed leads, median seconds, attainment and breaches by day and region; unknown seconds stay in the denominator."""
    late, ok = F.count_if(F.col("route_seconds") > seconds), F.count_if(F.col("route_seconds") <= seconds)
    return stage.where(F.col("event_type") == event_type).groupBy(F.to_date("event_timestamp").alias("day"), "region").agg(F.count("*").alias("routed"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY route_seconds)").cast("double").alias("median_seconds"), _ratio(ok, F.count("*")).alias("attainment"), late.alias("breaches"))


def data_quality(stage: DataFrame) -> DataFrame:
    """Duplicates, missing owners, invalid stages and the share of clean events by day."""
    bad = {"duplicates": F.col("is_duplicate"), "missing_owner": F.col("owner_id").isNull(), "invalid_stage": ~F.col("lifecycle_stage").isin(*STAGES)}
    sums = [F.count_if(c).alias(k) for k, c in bad.items()]
    out = stage.groupBy(F.to_date("event_timestamp").alias("day")).agg(F.count("*").alias("events"), *sums)
    return out.withColumn("quality_rate", _ratio(F.col("events") - F.col("duplicates") - F.col("missing_owner") - F.col("invalid_stage"), F.col("events")))


def live_state(events: DataFrame, days: int = 30) -> DataFrame:
    """One row over the trailing days before the newest event, duplicates of deliveries included; text columns hold JSON."""
    newest = events.agg(F.max("event_timestamp").alias("as_of"))
    recent = events.crossJoin(F.broadcast(newest)).where(F.col("event_timestamp") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"))
    n = F.greatest(F.count("*"), F.lit(1))
    pct = lambda c: F.round(F.count_if(c) * 100.0 / n, 1)
    return recent.agg(
        F.count("*").alias("events"),
        F.countDistinct("lead_id").alias("leads"),
        *(F.count_if(F.col("lifecycle_stage") == s).alias(f"n_{s}") for s in STAGES),
        F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY route_seconds)").cast("double"), F.lit(0.0)).alias("median_seconds"),
        pct(F.col("route_seconds") <= SLA_SECONDS).alias("sla_percent"),
        pct(F.col("owner_id").isNull()).alias("unowned_percent"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("lifecycle_stage") == "closed_won", F.col("opportunity_amount"))), F.lit(0)).alias("won_revenue"),
        F.max(F.when(F.col("lifecycle_stage").startswith("closed"), F.col("event_timestamp"))).alias("last_won_at"),
        F.max_by("owner_id", F.when(F.col("owner_id").isNotNull(), F.struct("event_timestamp", "event_id"))).alias("latest_owner"),
    )


def latest_json(events: DataFrame, keep: int = 6) -> DataFrame:
    """The newest events as a JSON array of objects, and how many there are in all."""
    top = events.orderBy(F.desc("event_timestamp"), F.desc("event_id"), F.desc("lifecycle_stage")).limit(keep)
    item = F.struct(F.col("event_timestamp").alias("at"), "event_id", "lifecycle_stage")
    shape = F.transform(F.sort_array(F.collect_list(item), asc=False), lambda x: F.struct(x["event_id"].alias("id"), x["lifecycle_stage"].alias("stage")))
    return top.agg(F.to_json(shape, {"ignoreNullFields": "false"}).alias("events_json"))


def violations(df: DataFrame, name: str, kind: str, column: str, accepted: tuple[str, ...] = ()) -> DataFrame:
    """Rows (check, column, value, n) that break a constraint: not_null, unique, accepted_values or nonnegative."""
    value = F.col(column).cast("string")
    bad = {"not_null": F.col(column).isNull(), "accepted_values": ~F.col(column).isin(*accepted), "nonnegative": F.col(column) < 0}
    rows = df.groupBy(value.alias("value")).count().where("count > 1 AND value IS NOT NULL") if kind == "unique" else df.where(bad[kind]).groupBy(value.alias("value")).count()
    return rows.select(F.lit(f"{name}.{kind}").alias("check"), F.lit(column).alias("column"), "value", F.col("count").alias("n"))


def freshness(events: DataFrame, as_of: Column, warn_hours: int = 2, error_hours: int = 6) -> DataFrame:
    """Age of the newest delivery against a given time: ok, warn or error."""
    out = events.agg(F.max("ingested_at").alias("newest")).withColumn("as_of", as_of)
    hours = (F.unix_timestamp(F.col("as_of").cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
    return out.withColumn("status", F.when(hours > error_hours, "error").when(hours > warn_hours, "warn").otherwise("ok"))


def conversion(events: DataFrame) -> DataFrame:
    """Leads whose greatest stage is at or beyond each stage, and per cent of the first; unknown stages rank 1."""
    rank = F.coalesce(*(F.when(F.col("lifecycle_stage") == s, F.lit(i + 1)) for i, s in enumerate(STAGES)), F.lit(1))
    best = events.groupBy("lead_id").agg(F.max(rank).alias("r"))
    counts = best.agg(*(F.count_if(F.col("r") >= i + 1).alias(s) for i, s in enumerate(STAGES)))
    rows = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.lit(s).alias("stage"), F.col(s).alias("leads"), F.when(F.col(STAGES[0]) == 0, 0.0).otherwise(F.round(F.col(s) * 100.0 / F.col(STAGES[0]), 1)).alias("percent")) for i, s in enumerate(STAGES)))).alias("x")
    return counts.select(rows).select("x.*")
