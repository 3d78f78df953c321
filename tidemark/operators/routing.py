"""Lead scoring, triage, policy routing, account matching and the inbound pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators.ranks import ranked


def lead_score(revenue: Column, employees: Column, intent: Column) -> Column:
    """min(100, rounded sum of revenue, size and intent parts)."""
    return F.least(F.lit(100), F.floor(revenue / 500_000 + employees / 20 + 25 * intent + 0.5)).cast("long")


def segment(revenue: Column) -> Column:
    return F.when(revenue >= 20_000_000, "Enterprise").when(revenue >= 5_000_000, "Mid-Market").otherwise("SMB")


def scored_leads(leads: DataFrame) -> DataFrame:
    """Leads with score, segment, owner pool and stage."""
    seg = segment(F.col("revenue"))
    code = F.when(seg == "Enterprise", "ENT").when(seg == "Mid-Market", "MM").otherwise("SMB")
    score = lead_score(F.col("revenue"), F.col("employees"), F.col("intent"))
    return leads.withColumns({"score": score, "segment": seg, "owner": F.concat(F.upper(F.substring("region", 1, 2)), F.lit("-"), code), "stage": F.when(score >= 70, "mql").otherwise("lead")})


def triage(leads: DataFrame) -> DataFrame:
    """Readiness: 25 each for a usable email, company and name, 15 for a phone, 10 for a website; ready from 75."""
    there = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("int")
    at = F.instr("email", "@")
    mail = F.coalesce((at > 1) & F.col("email").contains(".") & (F.length("email") - F.instr(F.reverse("email"), ".") + 1 > at + 1), F.lit(False)).cast("int")
    out = leads.withColumn("readiness", 25 * mail + 25 * there("company") + 25 * there("last_name") + 15 * there("phone") + 10 * there("website"))
    return out.withColumn("ready", F.col("readiness") >= 75)


def policy_routes(leads: DataFrame, policies: DataFrame) -> DataFrame:
    """Each lead's first policy by priority and name: score at or above its least score, segment blank or equal but for case. Leads meet the policies of their segment and the blank ones by key."""
    p = policies.select(F.col("name").alias("policy"), "priority", "min_score", F.lower(F.coalesce("segment", F.lit(""))).alias("__key"), "queue")
    met = leads.select("lead_id", "score", F.explode(F.array_distinct(F.array(F.lit(""), F.lower(F.coalesce("segment", F.lit("")))))).alias("__key")).join(p, "__key").where("score >= min_score")
    best = leads.select("lead_id").distinct().join(met.groupBy("lead_id").agg(F.min(F.struct("priority", "policy", "queue")).alias("p")), "lead_id", "left")
    return best.select("lead_id", "p.policy", "p.queue", F.when(F.col("p.policy").isNull(), "no_policy").otherwise("routed").alias("status"))


def match_accounts(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (request_id, company, email) against accounts (account_id, name, domain): name and domain on one account decide; either alone is a conflict."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    r = requests.select("request_id", key("company").alias("n"), F.lower(F.substring_index("email", "@", -1)).alias("d"))
    a = accounts.select("account_id", key("name").alias("an"), F.lower("domain").alias("ad"))
    by_name = r.join(a, F.col("n") == F.col("an")).select("request_id", "account_id", F.lit(1).alias("by_name"), F.lit(0).alias("by_domain"))
    by_domain = r.join(a, F.col("d") == F.col("ad")).select("request_id", "account_id", F.lit(0), F.lit(1))
    hits = by_name.union(by_domain).groupBy("request_id", "account_id").agg(F.max("by_name").alias("n"), F.max("by_domain").alias("d"))
    both = (F.col("n") == 1) & (F.col("d") == 1)
    per = hits.groupBy("request_id").agg(F.count("*").alias("hits"), F.count_if(both).alias("whole"), F.min(F.when(both, F.col("account_id"))).alias("account_id"))
    out = r.select("request_id").join(per, "request_id", "left")
    status = F.when(F.col("hits").isNull(), "new").when((F.col("whole") == 1) & (F.col("hits") == 1), "matched").otherwise("conflict")
    return out.select("request_id", status.alias("status"), F.when(status == "matched", F.col("account_id")).alias("account_id"))


def slots(reps: DataFrame) -> DataFrame:
    """(region, segment, slot, rep_id): the free places of the active reps (rep_id, region, segment, active, capacity, assigned) in the order in which they are given away.

    The least used rep goes first, and a rep's use only grows, so the order in which a pool's places go is that of the use each is taken at: places taken before, by capacity; then rep id."""
    free = reps.where("active AND assigned < capacity").select("region", "segment", "rep_id", "capacity", F.explode(F.sequence(F.col("assigned"), F.col("capacity") - 1)).alias("taken"))
    use = F.col("taken") / F.col("capacity")
    return ranked(free, ["region", "segment"], [use.asc(), F.col("rep_id").asc()], "slot").select("region", "segment", "slot", "rep_id")


def assign(requests: DataFrame, reps: DataFrame) -> DataFrame:
    """(request_id, rep_id, status): requests (seq, request_id, region, segment) in turn to the least used active rep of their region and segment (then id) with room; else held.

    No fold: the n-th request of a pool gets the pool's n-th place. Requests without a region or segment are held."""
    turn = ranked(requests.select("seq", "request_id", "region", "segment"), ["region", "segment"], [F.col("seq").asc(), F.col("request_id").asc()], "slot")
    rows = turn.join(slots(reps), ["region", "segment", "slot"], "left")
    return rows.select("request_id", "rep_id", F.when(F.col("rep_id").isNull(), "held").otherwise("routed").alias("status"))


# Monthly spend from which a request is for the Enterprise pool.
ENTERPRISE_SPEND = 35_000


def inbound(requests: DataFrame, leads: DataFrame, accounts: DataFrame, reps: DataFrame) -> DataFrame:
    """(request_id, status, reason, lead_id, account_id, owner_id, region, segment) of requests (request_id, first_name, last_name, company, email, region, spend) before any pool is balanced.

    Held: what is invalid, whose company and domain point to different accounts, whose known lead has another account, or whose owner is away. Owned: a lead's owner, else its
    account's. Pool: the rest, with the region and segment that ``assign`` takes. leads: (lead_id, email, account_id, owner_id); accounts: (account_id, name, domain, region, spend, owner_id); reps: (rep_id, active)."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    mail = F.lower(F.trim("email"))
    rows = requests.select("request_id", (there("first_name") & there("last_name") & there("company") & F.coalesce(mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))).alias("valid"), mail.alias("e"), F.substring_index(mail, "@", -1).alias("d"), T.company_key(F.col("company")).alias("n"), F.col("region").alias("own_region"), F.col("spend").alias("own_spend"))
    known = leads.groupBy(F.lower(F.trim("email")).alias("e")).agg(F.min(F.struct("lead_id", "account_id", "owner_id")).alias("lead"))
    account = F.struct("account_id", "region", "spend", "owner_id")
    by_domain = accounts.groupBy(F.lower("domain").alias("d")).agg(F.min(account).alias("by_domain"))
    by_name = accounts.groupBy(T.company_key(F.col("name")).alias("n")).agg(F.min(account).alias("by_name"))
    rows = rows.join(known, "e", "left").join(by_domain, "d", "left").join(by_name, "n", "left")
    a, named, lead = (lambda c: F.col("by_domain")[c]), F.col("by_name.account_id"), (lambda c: F.col("lead")[c])
    rows = rows.withColumns({"owner": F.coalesce(lead("owner_id"), a("owner_id")), "place": F.coalesce(a("region"), F.col("own_region")), "money": F.coalesce(a("spend"), F.col("own_spend"))})
    away = reps.where("active").select(F.col("rep_id").alias("owner"), F.lit(True).alias("here"))
    rows = rows.join(away, "owner", "left")
    reason = (
        F.when(~F.col("valid"), "invalid")
        .when(named.isNotNull() & ~named.eqNullSafe(a("account_id")), "account_conflict")
        .when(F.col("lead").isNotNull() & ~lead("account_id").eqNullSafe(a("account_id")), "other_account")
        .when(F.col("owner").isNotNull() & F.col("here").isNull(), "owner_away")
        .when(F.col("owner").isNull() & ~there("place"), "no_region")
        .when(F.col("owner").isNull() & (F.col("money").isNull() | (F.col("money") < 0)), "no_budget")
    )
    rows = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    pool = good & F.col("owner").isNull()
    status = F.when(~good, "held").when(pool, "pool").otherwise("owned")
    return rows.select("request_id", status.alias("status"), "reason", F.when(good, lead("lead_id")).alias("lead_id"), F.when(good, a("account_id")).alias("account_id"), F.when(good, F.col("owner")).alias("owner_id"), F.when(pool, F.col("place")).alias("region"), F.when(pool, F.when(F.col("money") >= ENTERPRISE_SPEND, "Enterprise").otherwise("Growth")).alias("segment"))


def intake(requests: DataFrame, contacts: DataFrame, leads: DataFrame, accounts: DataFrame, users: DataFrame, create_contacts: bool = False) -> DataFrame:
    """(request_id, action, reason, person_id, account_id, owner_id): what a form (request_id, email, company, payload) leads to.

    One known person is reused; several are held; none becomes a lead of the intake user (owner null), or, with create_contacts, a contact of the account of its company. With it, a lead is
    converted into the account unless its company differs, and a contact without an account gets it; an unknown company makes a new account (account null). Persons whose owner is no active user are held, and so is
    a request id that came with two payloads. contacts: (id, email, owner_id, account_id); leads: (id, email, owner_id, company); accounts: (account_id, name, owner_id); users: (user_id, active)."""
    mail = F.lower(F.trim("email"))
    r = requests.groupBy("request_id").agg(F.min("email").alias("email"), F.min("company").alias("company"), (F.min("payload") != F.max("payload")).alias("clash"))
    r = r.select("request_id", mail.alias("e"), T.company_key(F.col("company")).alias("n"), "clash")
    c = contacts.groupBy(mail.alias("e")).agg(F.count("*").alias("cs"), F.min(F.struct("id", "owner_id", "account_id")).alias("c"))
    p = leads.groupBy(mail.alias("e")).agg(F.count("*").alias("ls"), F.min(F.struct("id", "owner_id", T.company_key(F.col("company")).alias("n"))).alias("l"))
    a = accounts.groupBy(T.company_key(F.col("name")).alias("n")).agg(F.count("*").alias("same"), F.min(F.struct("account_id", "owner_id")).alias("a"))
    rows = r.join(c, "e", "left").join(p, "e", "left").join(a, "n", "left").fillna(0, ["cs", "ls", "same"])
    theirs = accounts.select(F.col("account_id").alias("__acc"), F.col("owner_id").alias("__acc_owner"))
    rows = rows.join(theirs, F.col("c.account_id") == F.col("__acc"), "left")
    wants = F.lit(create_contacts) & ((F.col("cs") == 0) | F.col("c.account_id").isNull())
    action = F.when(F.col("cs") > 0, F.when(wants, "attach_contact").otherwise("reuse_contact")).when(F.col("ls") > 0, F.when(wants, "convert_lead").otherwise("reuse_lead")).when(wants, "create_contact").otherwise("create_lead")
    account = F.when(wants, F.col("a.account_id")).otherwise(F.col("c.account_id"))
    owner = F.when(wants, F.coalesce("a.owner_id", "l.owner_id")).when(F.col("cs") > 0, F.when(F.lit(create_contacts), F.coalesce("__acc_owner", "c.owner_id")).otherwise(F.col("c.owner_id"))).otherwise(F.col("l.owner_id"))
    rows = rows.withColumns({"action": action, "account_id": account, "owner_id": owner})
    rows = rows.join(users.where("active").select(F.col("user_id").alias("owner_id"), F.lit(True).alias("here")), "owner_id", "left")
    reason = (
        F.when(F.col("clash"), "payload_conflict")
        .when(F.col("cs") + F.col("ls") > 1, "several_people")
        .when((F.col("action") == "convert_lead") & (F.col("l.n") != F.col("n")), "lead_company")
        .when(wants & (F.col("same") > 1), "several_accounts")
        .when(F.col("owner_id").isNotNull() & F.col("here").isNull(), "owner_inactive")
    )
    rows = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    person = F.coalesce("c.id", "l.id")
    return rows.select("request_id", F.when(good, F.col("action")).otherwise("hold").alias("action"), "reason", F.when(good, person).alias("person_id"), F.when(good, F.col("account_id")).alias("account_id"), F.when(good, F.col("owner_id")).alias("owner_id"))


def ranked_reps(reps: DataFrame) -> DataFrame:
    """Active reps with room by use, then id, in each region and segment."""
    w = Window.partitionBy("region", "segment").orderBy(F.col("assigned") / F.col("capacity"), "rep_id")
    return reps.where("active AND assigned < capacity").withColumn("rank", F.row_number().over(w))


def company_key(raw: Column) -> Column:
    return T.company_key(raw)
