"""State as data: upserts, ledgers, retention, receipts, write plans and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_newest(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the newest; new rows win ties."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = rows.groupBy(key).agg(F.max(F.struct(at, "__new", *(c for c in old.columns if c not in (key, at)))).alias("r"))
    return best.select(*(F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in old.columns))


def upsert_findings(old: DataFrame, found: DataFrame) -> DataFrame:
    """Findings (key, status, occurrences): found again counts up and reopens a closed one; open ones not found any more are resolved."""
    f = found.select(F.col("key").alias("__k")).distinct()
    rows = old.join(f, old["key"] == F.col("__k"), "full_outer")
    again, gone = F.col("key").isNotNull() & F.col("__k").isNotNull(), F.col("__k").isNull()
    return rows.select(
        F.coalesce("key", "__k").alias("key"),
        F.when(gone, F.when(F.col("status") == "open", "resolved").otherwise(F.col("status"))).otherwise("open").alias("status"),
        F.when(gone, F.col("occurrences")).when(again, F.col("occurrences") + (F.col("status") != "open").cast("int")).otherwise(1).cast("long").alias("occurrences"),
    )


def insert_new(ledger: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger lacks, one per key."""
    return rows.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def newest(rows: DataFrame, by: str, at: str, keep: int, tie: str) -> DataFrame:
    """The newest so many rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(at), tie)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def combined_receipts(receipts: DataFrame) -> DataFrame:
    """Counts by status of each contact's last receipt (contact_id, seq, status)."""
    last = receipts.groupBy("contact_id").agg(F.max(F.struct("seq", "status")).alias("r"))
    return last.groupBy("r.status").agg(F.count("*").alias("n"))


def write_plan(inputs: DataFrame, existing: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(contact_id, decision, native_id, changes) of inputs against existing rows by email: rows without an email or with several matches or one target for several inputs are held; without a match they are created; else blanks are filled, and other differences are for review."""
    mail = F.lower(F.trim("email"))
    e = existing.select(F.lower(F.trim("email")).alias("__m"), F.col("native_id"), *(F.col(f).alias(f"__{f}") for f in fields))
    n = e.where("__m IS NOT NULL AND __m <> ''").groupBy("__m").agg(F.count("*").alias("matches"), F.min(F.struct("native_id", *(f"__{f}" for f in fields))).alias("t"))
    rows = inputs.withColumn("__e", mail).join(n, F.col("__e") == F.col("__m"), "left")
    claims = rows.where("t.native_id IS NOT NULL").groupBy(F.col("t.native_id").alias("__t")).agg(F.count("*").alias("claims"))
    rows = rows.join(claims, F.col("t.native_id") == F.col("__t"), "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    step = [F.when(blank(f) | F.col(f).eqNullSafe(F.col(f"t.__{f}")), F.lit(None)).when(blank(f"t.__{f}"), F.concat(F.lit(f"fill:{f}"))).otherwise(F.lit(f"review:{f}")) for f in fields]
    rows = rows.withColumn("changes", F.array_compact(F.array(*step)))
    decision = (
        F.when(blank("email"), "hold_no_email")
        .when(F.col("matches") > 1, "hold_ambiguous")
        .when(F.col("matches").isNull(), "create")
        .when(F.col("claims") > 1, "hold_shared_target")
        .when(F.size("changes") == 0, "unchanged")
        .when(F.exists("changes", lambda x: x.startswith("review:")), "review")
        .otherwise("update")
    )
    return rows.select("contact_id", decision.alias("decision"), "t.native_id", F.when(F.col("matches") == 1, F.array_join("changes", "|")).otherwise("").alias("changes"))


def verify_run(expected: DataFrame, actual: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(record_id, status, differing fields) of expected against actual rows."""
    a = actual.select(F.col("record_id").alias("__id"), *(F.col(f).alias(f"__{f}") for f in fields))
    rows = expected.join(a, expected["record_id"] == F.col("__id"), "left")
    diff = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("__id").isNull(), "missing").when(F.size(diff) > 0, "different").otherwise("verified")
    return rows.select("record_id", status.alias("status"), F.when(F.col("__id").isNull(), "").otherwise(F.array_join(diff, "|")).alias("fields"))


def work_queue(sources: dict[str, DataFrame], limit: int = 100) -> DataFrame:
    """The newest items (id, status, updated_at) of several sources, each limited first."""
    out = None
    for kind, df in sources.items():
        part = df.select(F.lit(kind).alias("kind"), "id", "status", "updated_at").orderBy(F.desc("updated_at"), "id").limit(limit)
        out = part if out is None else out.unionByName(part)
    done = F.col("status").isin("done", "resolved", "closed")
    return out.withColumn("state", F.when(done, "done").when(F.col("status") == "failed", "needs_attention").otherwise("open")).orderBy(F.desc("updated_at"), "kind", "id").limit(limit)


def triage(items: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, version, status, assignee, outcome) of items (id, version, status, assignee) after patches (id, expected_version, status, assignee; null: as it was): applied and counted up where the version is the expected one, else a conflict that changes nothing; outcome null: no patch. Of several patches of one item the first by status, then assignee, counts, since only one can find the version it expects."""
    p = patches.groupBy(F.col("id").alias("__id")).agg(F.min(F.struct("expected_version", "status", "assignee")).alias("p"))
    rows = items.join(p, items["id"] == F.col("__id"), "left")
    hit = F.col("p").isNotNull() & (F.col("p.expected_version") == F.col("version"))
    new = lambda c: F.when(hit, F.coalesce(F.col(f"p.{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return rows.select("id", (F.col("version") + hit.cast("int")).cast("long").alias("version"), new("status"), new("assignee"), F.when(F.col("p").isNull(), None).when(hit, "applied").otherwise("conflict").alias("outcome"))


def undo(revisions: DataFrame, keep: int = 20) -> DataFrame:
    """(id, revision, restored) of the next revision of every document (id, revision, payload): the payload before the last one, null where there is none to go back to. Only the newest revisions can be restored."""
    w = Window.partitionBy("id").orderBy(F.desc("revision"))
    newest = revisions.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.least(F.lit(2), F.lit(keep)))
    per = newest.groupBy("id").agg((F.max("revision") + 1).alias("revision"), F.max(F.when(F.col("r") == 2, F.col("payload"))).alias("restored"))
    return per.select("id", "revision", "restored")
