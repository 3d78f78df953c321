"""What arrives from CRMs: canonical records, polled pages, webhook and change-event hints, delivery checkpoints, the work queue, native reversals, proposals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Objects of webhook types, change types of an event bus, hours of its retention, attempts before an event is held, signs of a row that its source still reviews.
OBJECTS = {"contact": "Contact", "company": "Company", "deal": "Deal"}
FAMILIES = ("creation", "propertyChange", "deletion", "restore", "associationChange", "merge")
RETENTION_HOURS, ATTEMPTS, PAGE, GIVE_UP = 72, 3, 50, 10_000
REVIEWED = r"(?i)review|error|fail|stale|blocked"
PROPOSAL = "schemaVersion int, source string, mode string, workspaceId string, sourceInstanceId string, guards struct<maxRecords:int,allowCreate:boolean>, records array<struct<rowId:string,externalKey:string,sourceStatus:string,proposedFields:map<string,string>>>"
PORTABLE = ("fullName", "firstName", "lastName", "email", "company", "phone", "jobTitle", "website")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def canonical(rows: DataFrame, provider: str) -> DataFrame:
    """Identity records of provider rows (native_id, object_type, first_name, last_name, email, other_emails joined by ';', company, phone, mobile, job_title, website): the mobile number stands in for a missing phone, else it is the second one."""
    blank = _text("phone") == ""
    emails = F.array_distinct(F.filter(F.transform(F.split(_text("other_emails"), ";"), lambda e: F.trim(e)), lambda e: e != ""))
    name = F.concat_ws(" ", F.when(_text("first_name") != "", F.col("first_name")), F.when(_text("last_name") != "", F.col("last_name")))
    return rows.select(
        F.concat_ws(":", F.lit(provider), "object_type", "native_id").alias("record_key"), "object_type", _text("first_name").alias("first_name"), _text("last_name").alias("last_name"), name.alias("full_name"), _text("email").alias("email"), emails.alias("additional_emails"),
        _text("company").alias("company"), F.when(blank, _text("mobile")).otherwise(F.col("phone")).alias("phone"), F.when(blank, "").otherwise(_text("mobile")).alias("secondary_phone"), _text("job_title").alias("job_title"), _text("website").alias("website"),
    )


def poll_page(records: DataFrame, since: Column, until: Column, after_id: Column, size: int = PAGE) -> DataFrame:
    """The next page of a frozen window: records (id, modified) changed in it, by id beyond the cursor."""
    return records.where((F.col("modified") >= since) & (F.col("modified") <= until) & (F.col("id") > after_id)).orderBy("id").limit(size)


def poll_windows(accounts: DataFrame, as_of: str, lag: int = 120, overlap: int = 300, reconcile_hours: int = 24) -> DataFrame:
    """(account_id, since, until, full) of the next windows of accounts (account_id, watermark, reconciled_at, waiting: changes in the window): up to a lag before now, from an overlap before the last; a full pass when the last is a day old, there was none or GIVE_UP changes wait."""
    now = F.lit(as_of).cast("timestamp_ntz")
    seconds = lambda n: F.expr(f"INTERVAL {n} SECONDS")
    full = F.col("watermark").isNull() | F.col("reconciled_at").isNull() | (F.col("reconciled_at") <= now - seconds(reconcile_hours * 3600)) | (F.coalesce("waiting", F.lit(0)) >= GIVE_UP)
    return accounts.select("account_id", F.when(~full, F.col("watermark") - seconds(overlap)).alias("since"), (now - seconds(lag)).alias("until"), full.alias("full"))


def linked(records: DataFrame, links: DataFrame, read: DataFrame) -> DataFrame:
    """(id, related): the ids that links (id, target) name, as a JSON list; '[]' for none; null where the record's links were not read (read: id): unknown is not empty."""
    ids = links.groupBy("id").agg(F.to_json(F.sort_array(F.collect_set("target"))).alias("ids"))
    rows = records.select("id").join(read.select("id").distinct().withColumn("known", F.lit(True)), "id", "left").join(ids, "id", "left")
    return rows.select("id", F.when(F.col("known"), F.coalesce("ids", F.lit("[]"))).alias("related"))


def webhook_hints(events: DataFrame) -> DataFrame:
    """(event_id, object_type, record_id, kind) of events (event_id, subscription, object_id, association_type, from_id, to_id, removed, primary_id, new_id, merged_ids): refresh or delete hints, and gaps (record_id null) where the evidence leaves the current state open. Subscriptions of other objects or families give none."""
    kinds = F.create_map(*(F.lit(x) for kv in OBJECTS.items() for x in kv))
    part = lambda n: F.split_part("subscription", F.lit("."), F.lit(n))
    family, kind = part(2), kinds[part(1)]
    ends = F.when(F.col("association_type").rlike("^[A-Z_]+_TO_[A-Z_]+$"), F.split(F.lower("association_type"), "_to_"))
    hint = lambda t, i, k: F.struct(t.alias("object_type"), i.alias("record_id"), F.lit(k).alias("kind"))
    no_id = F.lit(None).cast("string")
    from_type, to_type = kinds[F.get(ends, F.lit(0))], kinds[F.get(ends, F.lit(1))]
    has_from, has_to = from_type.isNotNull() & F.col("from_id").isNotNull(), to_type.isNotNull() & F.col("to_id").isNotNull()
    same = has_from & (from_type == to_type) & (F.col("from_id") == F.col("to_id"))
    links = F.array(F.when(has_from, hint(from_type, F.col("from_id"), "refresh")), F.when(has_to & ~F.coalesce(same, F.lit(False)), hint(to_type, F.col("to_id"), "refresh")), F.when(~F.coalesce(has_from & has_to, F.lit(False)) | F.col("removed").isNull(), hint(kind, no_id, "gap")))
    survivor = F.coalesce("new_id", "primary_id")
    merges = F.array(F.when(survivor.isNotNull(), hint(kind, survivor, "refresh")), hint(kind, no_id, "gap"))
    plain = F.array(F.when(F.col("object_id").isNotNull(), F.when(family == "deletion", hint(kind, F.col("object_id"), "delete")).otherwise(hint(kind, F.col("object_id"), "refresh"))))
    known = events.where(kind.isNotNull() & family.isin(*FAMILIES) & (F.size(F.split("subscription", r"\.")) == 2))
    return known.select("event_id", F.explode(F.array_compact(F.when(family == "associationChange", links).when(family == "merge", merges).otherwise(plain))).alias("h")).select("event_id", "h.*").distinct()


def change_hints(events: DataFrame) -> DataFrame:
    """(event_id, object_type, record_id, kind) of change events (event_id, entity, change_type, record_ids): a row per record, or one gap where the bus reports one or an id with a wildcard."""
    gap = F.col("change_type").startswith("GAP_") | F.exists("record_ids", lambda i: i.endswith("*"))
    kind = F.when(F.col("change_type") == "DELETE", "delete").otherwise("refresh")
    whole = events.where(gap).select("event_id", F.col("entity").alias("object_type"), F.lit(None).cast("string").alias("record_id"), F.lit("gap").alias("kind"))
    each = events.where(~gap).select("event_id", F.col("entity").alias("object_type"), F.explode("record_ids").alias("record_id"), kind.alias("kind"))
    return whole.union(each)


def content_digest(rows: DataFrame) -> Column:
    """Of a delivery's content (its body, where there is one): what tells a repeated delivery from another one that names the same replay id."""
    held = [c for c in ("channel", "replay_id", "previous_id", "gap_reason", "gaps", "body") if c in rows.columns]
    return F.sha2(F.to_json(F.struct(*held), {"ignoreNullFields": "false"}), 256)


def fold_deliveries(rows: pd.DataFrame, checkpoint: str | None = None, received: int | None = None, open_gap: bool = False) -> Iterator[tuple]:
    """(seq, digest, status, needs_reconciliation, replay_id, received) of one channel's deliveries in order of arrival, the last two as the checkpoint has them after it: accepted ones move the checkpoint, one whose content was accepted
    before (here, or a column known says so) is a duplicate, one that doesn't follow the checkpoint without a stated gap is a conflict."""
    seen: set[str] = set()
    known = rows["known"] if "known" in rows else [False] * len(rows)
    for r, old in sorted(zip(rows.itertuples(), known, strict=True), key=lambda x: x[0].seq):
        previous = None if pd.isna(r.previous_id) else r.previous_id
        stated = not pd.isna(r.gap_reason)
        if old or r.digest in seen:
            status = "duplicate"
        elif previous != checkpoint and not stated:
            status = "conflict"
        else:
            status = "accepted"
            late = received is not None and r.received - received > RETENTION_HOURS * 3600
            open_gap = bool(open_gap or stated or late or r.gaps)
            checkpoint, received = r.replay_id, int(r.received)
            seen.add(r.digest)
        yield r.seq, r.digest, status, open_gap, checkpoint, received


def deliveries(rows: DataFrame) -> DataFrame:
    """(channel, seq, status, needs_reconciliation) of deliveries (channel, seq, replay_id, previous_id, gap_reason, gaps: whether it holds gap events, received: seconds, body if there is one). A channel is one ordered stream, so it is folded in one task; ``tidemark.streaming.ledger`` folds only what is new."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([x[:4] for x in fold_deliveries(pdf)], columns=["seq", "digest", "status", "needs_reconciliation"]).drop(columns="digest")
        out.insert(0, "channel", pdf["channel"].iloc[0])
        return out

    return rows.withColumn("digest", content_digest(rows)).groupBy("channel").applyInPandas(run, "channel string, seq long, status string, needs_reconciliation boolean")


def due(queue: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """The oldest unprocessed events of a queue that aren't held and whose next attempt is due, 1 to 50 of them."""
    ready = F.col("processed_at").isNull() & ~F.col("held") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of))
    return queue.where(ready).orderBy("received_at", "id").limit(max(1, min(50, limit)))


def after_failures(queue: DataFrame, failed: DataFrame, as_of: Column) -> DataFrame:
    """The queue after failed attempts (id): one attempt more, another in a minute, held from the third on."""
    f = failed.select(F.col("id").alias("__id")).distinct()
    hit = F.col("__id").isNotNull() & F.col("processed_at").isNull()
    rows = queue.join(f, queue["id"] == F.col("__id"), "left")
    return rows.withColumns({"held": F.when(hit, F.col("attempts") >= ATTEMPTS - 1).otherwise(F.col("held")), "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")), "next_attempt_at": F.when(hit, as_of + F.expr("INTERVAL 60 SECONDS")).otherwise(F.col("next_attempt_at"))}).drop("__id")


def queue_status(queue: DataFrame) -> DataFrame:
    """Pending and held events and the oldest pending one, per account."""
    return queue.where("processed_at IS NULL").groupBy("account_id").agg(F.count("*").alias("pending"), F.count_if("held").alias("held"), F.min("received_at").alias("oldest"))


def retained(queue: DataFrame, as_of: Column, days: int = 30, most: int = 10_000) -> DataFrame:
    """Unprocessed events, and each account's newest processed ones of the last days, so many at most."""
    w = Window.partitionBy("account_id", F.col("processed_at").isNull()).orderBy(F.desc("received_at"), F.desc("id"))
    kept = F.col("processed_at").isNull() | ((F.col("received_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("__r") <= most))
    return queue.withColumn("__r", F.row_number().over(w)).where(kept).drop("__r")


def recent_events(events: DataFrame, keys: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events (id, record_key, related: keys, received_at) that name one of the keys (record_key), themselves or as related."""
    named = events.select("id", F.explode(F.array_union(F.array("record_key"), F.coalesce("related", F.array().cast("array<string>")))).alias("record_key"))
    hit = named.join(keys.select("record_key"), "record_key", "left_semi").select("id").distinct()
    return events.join(hit, "id", "left_semi").orderBy(F.desc("received_at"), F.desc("id")).limit(max(1, min(100, limit)))


def native_reversals(samples: DataFrame, least: int = 3) -> DataFrame:
    """(record_id, field, returns, last_at) of reported values (record_id, field, at, value, planned) that came back to earlier ones so often in one sequence. Times with two values or a planned change break a sequence; repeats of the last value don't count."""
    at = samples.groupBy("record_id", "field", "at").agg(F.max("value").alias("value"), (F.min("value") != F.max("value")).alias("tied"), F.max("planned").alias("planned"))
    key = ("record_id", "field")
    broken = (F.col("tied") | F.col("planned")).cast("int")
    rows = at.withColumn("run", F.sum(broken).over(Window.partitionBy(*key).orderBy("at"))).where(~(F.col("tied") | F.col("planned")))
    in_run = Window.partitionBy(*key, "run").orderBy("at")
    rows = rows.withColumn("last", F.lag("value").over(in_run)).where(~F.col("last").eqNullSafe(F.col("value")))
    rows = rows.withColumn("again", (F.row_number().over(Window.partitionBy(*key, "run", "value").orderBy("at")) > 1).cast("int"))
    per = rows.withColumn("returns", F.sum("again").over(in_run)).where(F.col("returns") >= least)
    last = per.groupBy(*key).agg(F.max(F.struct("at", "returns")).alias("m"))
    return last.select(*key, F.col("m.returns").alias("returns"), F.col("m.at").alias("last_at"))


def intents(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, kind) of notices for findings (id, status, occurrences) whose status or count changed, open and resolved ones only. The key is the same whenever the same change is seen again."""
    b = before.select("id", F.col("status").alias("__s"), F.col("occurrences").alias("__o"))
    rows = after.join(b, "id", "left").where(~(F.col("__s").eqNullSafe(F.col("status")) & F.col("__o").eqNullSafe(F.col("occurrences")))).where(F.col("status").isin("open", "resolved"))
    return rows.select(F.concat_ws(":", F.lit("finding"), "id", "occurrences", "status").alias("key"), "status")


def budget(repairs: DataFrame, as_of: Column, per_hour: int, per_record_day: int) -> DataFrame:
    """(account_id, record_id, hourly, daily, reason) for the records of repairs (account_id, record_id, started_at) of the last day: the daily limit of a record holds before the account's hourly one; null: neither is met."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    live = repairs.where((age <= 86_400) & (age >= 0)).withColumn("__h", (age <= 3600).cast("int"))
    hourly = live.groupBy("account_id").agg(F.sum("__h").alias("hourly"))
    rows = live.groupBy("account_id", "record_id").agg(F.count("*").alias("daily")).join(hourly, "account_id")
    return rows.select("account_id", "record_id", "hourly", "daily", F.when(F.col("daily") >= per_record_day, "record_daily").when(F.col("hourly") >= per_hour, "account_hourly").alias("reason"))


def policy_at(incidents: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """(incident_id, policy): that of the version an incident (incident_id, account_id, version) was found under, else the account's current one."""
    now = current.select("account_id", F.col("policy").alias("__now"))
    rows = incidents.join(history.select("account_id", "version", F.col("policy").alias("__then")), ["account_id", "version"], "left").join(now, "account_id", "left")
    return rows.select("incident_id", F.coalesce("__then", "__now").alias("policy"))


def proposals(files: DataFrame) -> DataFrame:
    """(path, row_id, contact_id, excluded, fields) of proposal files (path, json): contact_id is a digest of source, workspace and row; rows that their source still reviews are excluded. Files with a fault give one row with it in fault."""
    p = F.from_json("json", PROPOSAL)
    rows = files.select("path", p.alias("p"))
    ids = F.transform(F.coalesce("p.records", F.array().cast("array<struct<rowId:string,externalKey:string,sourceStatus:string,proposedFields:map<string,string>>>")), lambda r: r["rowId"])
    odd = F.exists("p.records", lambda r: F.size(F.array_except(F.map_keys(F.coalesce(r["proposedFields"], F.create_map().cast("map<string,string>"))), F.array(*map(F.lit, PORTABLE)))) > 0)
    fault = (
        F.when(F.col("p.source").isNull(), "not_json")
        .when(~F.col("p.mode").eqNullSafe(F.lit("preview")) | F.coalesce(F.col("p.guards.allowCreate"), F.lit(True)) | (F.coalesce(F.col("p.workspaceId"), F.lit("")) == ""), "not_a_preview")
        .when((F.size(ids) == 0) | (F.size(ids) > 100), "rows")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_row")
        .when(odd, "fields")
    )
    marked = rows.withColumn("fault", fault)
    digest = lambda r: F.sha2(F.to_json(F.array(F.col("p.sourceInstanceId"), F.col("p.workspaceId"), r["rowId"])), 256)
    good = marked.where("fault IS NULL").select("path", F.col("p"), F.explode("p.records").alias("r"))
    out = good.select("path", F.col("r.rowId").alias("row_id"), digest(F.col("r")).alias("contact_id"), F.coalesce(F.col("r.sourceStatus").rlike(REVIEWED), F.lit(False)).alias("excluded"), F.col("r.proposedFields").alias("fields"), F.lit(None).cast("string").alias("fault"))
    none = F.lit(None).cast("string")
    return out.unionByName(marked.where("fault IS NOT NULL").select("path", none.alias("row_id"), none.alias("contact_id"), F.lit(False).alias("excluded"), F.lit(None).cast("map<string,string>").alias("fields"), "fault"))


def new_uploads(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(provider, digest, path) of files (provider, path, content) that the ledger (provider, digest) lacks, one path for equal contents."""
    rows = files.select("provider", F.sha2("content", 256).alias("digest"), "path").groupBy("provider", "digest").agg(F.min("path").alias("path"))
    return rows.join(ledger.select("provider", "digest"), ["provider", "digest"], "left_anti")
