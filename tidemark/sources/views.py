"""CRM-shaped relations over the driver's tables, by integer arithmetic and concatenation only, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events, with a late re-delivery (stage churned) of every 50th."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    stage = F.when(F.col("event_type") == "view", "lead").when(F.col("event_type") == "click", "mql").when(F.col("event_type") == "signup", "sql")
    stage = stage.when(F.col("event_type") == "purchase", F.when(F.col("value") >= 10, "closed_won").otherwise("opportunity")).otherwise("churned")
    base = e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("lead_id"),
        F.concat(F.lit("acct-"), (F.col("user_id") % 20).cast("string")).alias("account_id"),
        F.when(F.col("event_id") % 5 == 0, " Lead_Routed ").otherwise("lifecycle_changed").alias("event_type"),
        F.col("ts").alias("event_timestamp"),
        stage.alias("lifecycle_stage"),
        F.element_at(F.array(*map(F.lit, ("West", "Central", "Southeast", "Northeast"))), (F.col("user_id") % 4 + 1).cast("int")).alias("region"),
        F.element_at(F.array(*map(F.lit, ("SMB", "Mid-Market", "Enterprise"))), (F.col("event_id") % 3 + 1).cast("int")).alias("segment"),
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("own-"), (F.col("event_id") % 7).cast("string"))).alias("owner_id"),
        F.when(k % 10 != 0, k * 4).alias("route_seconds"),
        F.round(F.col("value") * 100).cast("long").alias("opportunity_amount"),
        (F.col("event_id") % 173 == 0).alias("is_duplicate"),
        F.col("ts").alias("ingested_at"),
        F.col("event_id").alias("n"),
    )
    again = base.where("n % 50 = 0").withColumns({"lifecycle_stage": F.lit("churned"), "ingested_at": F.expr("ingested_at + INTERVAL 1 HOUR")})
    return base.unionByName(again).drop("n")


CRM_EVENTS_SQL = """base AS (SELECT CAST(event_id AS VARCHAR) event_id, CAST(user_id AS VARCHAR) lead_id, 'acct-' || CAST(user_id % 20 AS VARCHAR) account_id,
 CASE WHEN event_id % 5 = 0 THEN ' Lead_Routed ' ELSE 'lifecycle_changed' END event_type, ts event_timestamp,
 CASE event_type WHEN 'view' THEN 'lead' WHEN 'click' THEN 'mql' WHEN 'signup' THEN 'sql' WHEN 'purchase' THEN CASE WHEN value >= 10 THEN 'closed_won' ELSE 'opportunity' END ELSE 'churned' END lifecycle_stage,
 (['West','Central','Southeast','Northeast'])[user_id % 4 + 1] region, (['SMB','Mid-Market','Enterprise'])[event_id % 3 + 1] segment,
 CASE WHEN event_id % 17 <> 0 THEN 'own-' || CAST(event_id % 7 AS VARCHAR) END owner_id,
 CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 10 <> 0 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) * 4 END route_seconds,
 CAST(round(value * 100) AS BIGINT) opportunity_amount, event_id % 173 = 0 is_duplicate, ts ingested_at, event_id n FROM events),
crm_events AS (SELECT * EXCLUDE n FROM base UNION ALL SELECT * EXCLUDE n REPLACE ('churned' AS lifecycle_stage, ingested_at + INTERVAL 1 HOUR AS ingested_at) FROM base WHERE n % 50 = 0)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contacts: every fifth repeats the one before in another spelling; some emails are broken, some fields empty."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ident = F.when(k % 5 == 4, k - 1).otherwise(k)
    mail = F.concat(F.lit("lead"), ident.cast("string"), F.lit("@d"), (ident % 9).cast("string"), F.lit(".example.com"))
    raw = F.when(k % 16 == 14, F.concat(F.lit("lead"), k.cast("string"), F.lit(" at broken.test"))).when(k % 5 == 4, F.upper(mail)).when(k % 23 == 7, F.replace(mail, F.lit("@"), F.lit("+event@"))).otherwise(mail)
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (n + 1).cast("int"))
    stages = ("lead", "mql", "sql", "opportunity")
    return c.select(
        F.concat(F.lit("C-"), F.lpad(k.cast("string"), 8, "0")).alias("contact_id"),
        F.concat(pick(("Ada", "Bo", "Cy", "Di"), ident % 4), F.lit(" Smith"), (ident % 50).cast("string")).alias("full_name"),
        raw.alias("raw_email"),
        F.when(k % 13 == 4, "").otherwise(F.concat(F.lit("Company "), (ident % 40).cast("string"))).alias("company"),
        pick(("West", "Central", "Southeast", "Northeast"), k % 4).alias("region"),
        pick(("SMB", "Mid-Market", "Enterprise"), k % 3).alias("segment"),
        F.when(k % 7 == 3, "mql").otherwise(pick(stages, k % 4)).alias("lifecycle_stage"),
        F.when(k % 7 == 3, "opportunity").otherwise(pick(stages, k % 4)).alias("expected_lifecycle_stage"),
        F.when(k % 11 == 3, "").when((k % 4 == 3) & (k % 3 == 2), "NE-ENT-01").otherwise(F.concat(F.lit("OWN-"), (k % 6).cast("string"))).alias("owner_id"),
        F.lit("active").alias("record_status"),
    )


CONTACTS_SQL = """c0 AS (SELECT c_custkey k, CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 1 ELSE c_custkey END i FROM customer),
c1 AS (SELECT *, 'lead' || i || '@d' || (i % 9) || '.example.com' mail FROM c0),
contacts AS (SELECT 'C-' || lpad(CAST(k AS VARCHAR), 8, '0') contact_id, (['Ada','Bo','Cy','Di'])[i % 4 + 1] || ' Smith' || (i % 50) full_name,
 CASE WHEN k % 16 = 14 THEN 'lead' || k || ' at broken.test' WHEN k % 5 = 4 THEN upper(mail) WHEN k % 23 = 7 THEN replace(mail, '@', '+event@') ELSE mail END raw_email,
 CASE WHEN k % 13 = 4 THEN '' ELSE 'Company ' || (i % 40) END company, (['West','Central','Southeast','Northeast'])[k % 4 + 1] region, (['SMB','Mid-Market','Enterprise'])[k % 3 + 1] segment,
 CASE WHEN k % 7 = 3 THEN 'mql' ELSE (['lead','mql','sql','opportunity'])[k % 4 + 1] END lifecycle_stage,
 CASE WHEN k % 7 = 3 THEN 'opportunity' ELSE (['lead','mql','sql','opportunity'])[k % 4 + 1] END expected_lifecycle_stage,
 CASE WHEN k % 11 = 3 THEN '' WHEN k % 4 = 3 AND k % 3 = 2 THEN 'NE-ENT-01' ELSE 'OWN-' || (k % 6) END owner_id, 'active' record_status FROM c1)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity records: customers, and suppliers as near copies of the customer with their key (one letter of the surname and the email's dots differ)."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    kinds = c.withColumn("kind", F.lit("contact")).unionByName(s.withColumn("kind", F.lit("lead")))
    k, lead = F.col("k"), F.col("kind") == "lead"
    s_k = k.cast("string")
    given = F.element_at(F.array(*map(F.lit, ("Ada", "Bruno", "Cyrus", "Diana", "Edgar", "Fay", "Gus"))), (k % 7 + 1).cast("int"))
    family = F.concat(F.element_at(F.array(*map(F.lit, ("Morgan", "Keller", "Lindqvist", "Okafor"))), (k % 4 + 1).cast("int")), F.translate(s_k, "0123456789", "abcdefghij"))
    return kinds.select(
        F.concat(F.col("kind"), F.lit(":"), s_k).alias("record_key"),
        F.col("kind").alias("object_type"),
        given.alias("first_name"),
        family.alias("last_name"),
        F.when(k % 6 == 5, "").when(lead & (k % 3 == 0), F.concat(F.lit("p."), s_k, F.lit("+x@gmail.com"))).when(k % 3 == 0, F.concat(F.lit("p"), s_k, F.lit("@gmail.com"))).otherwise(F.concat(F.lit("p"), s_k, F.lit("@corp"), (k % 30).cast("string"), F.lit(".example"))).alias("email"),
        F.when(k % 10 == 9, "").otherwise(F.concat(F.lit("Corp "), (k % 30).cast("string"), F.when(lead, F.lit(" Inc.")).otherwise(F.lit("")))).alias("company"),
        F.when(k % 4 == 0, F.concat(F.lit("+1 412 555 "), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 4 == 1, F.concat(F.lit("412-556-"), F.lpad((F.floor(k / 100) % 10000).cast("string"), 4, "0"))).otherwise("").alias("phone"),
        F.when(k % 5 == 0, F.concat(F.lit("https://www.corp"), (k % 30).cast("string"), F.lit(".example/about"))).otherwise("").alias("website"),
        F.when(lead, "").otherwise("Analyst").alias("job_title"),
    )
