"""Duplicate people: candidate pairs by shared keys, evidence scores, cliques, survivors.

Candidates never come from a cross join. Phones on more than 3 records make no key, keys of more than 100 records
(but for emails and their alias families) are skipped, and email keys of more than 500 records pair everyone with the
smallest record key; these limits are part of the rules. Normal forms, scored pairs and clusters are each cut once, so what is
derived from them reads them. Cliques of pairs that score 75 or more are grown inside their connected components; pairs of
one component of two need no growing, and weaker pairs are decided by order alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.lineage import cut

# Uses of a phone that may be a key, records of a broad and of an exact key, evidence tones, markers of old records, fields of a person.
PHONE_USES, BROAD, EXACT = 3, 100, 500
STRONG, SUPPORTING, CONFLICT, WARNING = "strong", "supporting", "conflict", "warning"
STALE = r"(?:^|[.+_-])(archive|former|inactive|old|previous)(?:$|[.+_-])"
FIELDS = ("first_name", "last_name", "email", "company", "phone", "secondary_phone", "job_title", "website")


def normalized(records: DataFrame) -> DataFrame:
    """record_key and the normal forms that are compared, cut; phones is a set of (uses, phone), the rarest first. full_name and secondary_phone may lack."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    email = T.email(F.col("email"), strip_www=True)
    full = F.when(F.coalesce(F.trim(has("full_name")), F.lit("")) != "", has("full_name")).otherwise(F.concat_ws(" ", "first_name", "last_name"))
    out = records.select(
        "record_key",
        "object_type",
        email.alias("email"),
        T.name(F.col("first_name")).alias("first"),
        T.name(F.col("last_name")).alias("last"),
        T.name(full).alias("name"),
        T.company(F.col("company")).alias("company"),
        T.domain(F.col("website")).alias("site"),
        F.array_distinct(F.array_compact(F.array(T.phone(F.col("phone")), T.phone(has("secondary_phone"))))).alias("numbers"),
    )
    generic = F.replace(F.substring_index(F.substring_index("email", "@", 1), "+", 1), F.lit("."), F.lit("")).isin(*T.GENERIC_INBOXES)
    out = cut(
        out.withColumns(
            {
                "alias": T.email_alias(F.col("email")),
                "mail_domain": F.substring_index("email", "@", -1),
                "generic": F.coalesce(generic, F.lit(False)),
                "first_pairs": T.numbered_bigrams(F.col("first")),
                "last_pairs": T.numbered_bigrams(F.col("last")),
            }
        )
    )
    each = out.select("record_key", F.explode("numbers").alias("phone"))
    uses = each.groupBy("phone").agg(F.count("*").alias("uses"))
    phones = each.join(uses, "phone").groupBy("record_key").agg(F.sort_array(F.collect_list(F.struct("uses", "phone"))).alias("phones"))
    none = F.array().cast("array<struct<uses:bigint,phone:string>>")
    return cut(out.drop("numbers").join(phones, "record_key", "left").withColumn("phones", F.coalesce("phones", none)))


def block_keys(n: DataFrame) -> DataFrame:
    """(kind, key, record_key) of each record's keys."""
    c = F.col
    rare = lambda i: F.when(F.get("phones", F.lit(i))["uses"] <= PHONE_USES, F.get("phones", F.lit(i))["phone"])
    free = {"email": c("email"), "alias": c("alias"), "phone": rare(0), "phone2": rare(1)}
    mixed = {"name-company": ("name", "company"), "name-domain": ("name", "site"), "surname-domain": ("last", "mail_domain")}
    keys = [F.struct(F.lit(k.rstrip("2")).alias("kind"), v.alias("key")) for k, v in free.items()]
    keys += [F.struct(F.lit(k).alias("kind"), F.concat(c(a), F.lit(":"), c(b)).alias("key")) for k, (a, b) in mixed.items()]
    keys.append(F.struct(F.lit("loose").alias("kind"), F.concat(c("company"), F.lit(":"), F.substring(c("first"), 1, 1), F.lit(":"), F.substring(c("last"), 1, 1)).alias("key")))
    return n.select("record_key", F.explode(F.array(*keys)).alias("k")).where("k.key IS NOT NULL").select("k.kind", "k.key", "record_key").distinct()


def candidate_pairs(n: DataFrame) -> DataFrame:
    """Distinct (a, b), a before b, that share a usable key."""
    keys = block_keys(n)
    sizes = keys.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("record_key").alias("first")).where("n > 1")
    exact = F.col("kind").isin("email", "alias")
    used = keys.join(sizes.where(exact | (F.col("n") <= BROAD)), ["kind", "key"])
    stars = used.where((F.col("n") > EXACT) & (F.col("record_key") != F.col("first"))).select(F.col("first").alias("a"), F.col("record_key").alias("b"))
    small = used.where(F.col("n") <= EXACT).select("kind", "key", "record_key")
    pairs = small.withColumnRenamed("record_key", "a").join(small.withColumnRenamed("record_key", "b"), ["kind", "key"]).where("a < b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def scored_pairs(n: DataFrame) -> DataFrame:
    """(a, b, score, band, evidence) of candidate pairs with some positive evidence, cut; scores below 60 are left out."""
    side = lambda p: n.select(*(F.col(c).alias(f"{p}_{c}") for c in n.columns))
    rows = candidate_pairs(n).join(side("l"), F.col("a") == F.col("l_record_key")).join(side("r"), F.col("b") == F.col("r_record_key"))
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    same = lambda c: F.coalesce(l(c) == r(c), F.lit(False))
    both = lambda c: l(c).isNotNull() & r(c).isNotNull()
    item = lambda key, weight, tone: F.struct(F.lit(key).alias("key"), F.lit(weight).alias("weight"), F.lit(tone).alias("tone"))
    likeness = lambda c: T.numbered_dice(l(c), r(c), l(f"{c}_pairs"), r(f"{c}_pairs"))
    # once a pair, and before the rules that read them
    rows = rows.withColumns({"first_like": likeness("first"), "last_like": likeness("last"), "met": F.get(F.array_intersect("l_phones", "r_phones"), F.lit(0))})
    no_phone = (F.size("l_phones") == 0) & (F.size("r_phones") == 0)
    first_fits = same("first") | ((F.substring(l("first"), 1, 1) == F.substring(r("first"), 1, 1)) & (F.col("first_like") >= 0.55))
    generic = l("generic") | r("generic")
    compatible = F.coalesce(F.col("last_like") >= 0.82, F.lit(False)) & (~both("first") | F.coalesce(first_fits, F.lit(False)))
    rules = [
        F.when(same("email"), F.when(generic, item("exact_email", 40, WARNING)).otherwise(item("exact_email", 96, STRONG))).when(same("alias"), F.when(l("alias").endswith("@gmail.com"), item("email_alias", 72, SUPPORTING)).otherwise(item("email_alias", 55, SUPPORTING))),
        F.when(F.col("met").isNotNull(), F.when(F.col("met.uses") > PHONE_USES, item("phone", 16, WARNING)).otherwise(item("phone", 54, STRONG))),
        F.when(same("name"), item("name", 34, STRONG)).when(compatible, item("name_compatible", 22, SUPPORTING)),
        F.when(same("company"), item("company", 18, SUPPORTING)),
        F.when(same("site"), item("website_domain", 20, SUPPORTING)),
        F.when(same("mail_domain") & ~l("mail_domain").isin(*T.FREE_DOMAINS), item("email_domain", 8, SUPPORTING)),
        F.when(both("last") & (F.col("last_like") < 0.55), item("last_name_conflict", -38, CONFLICT)),
        F.when(both("first") & ~first_fits, item("first_name_conflict", -22, CONFLICT)),
        F.when((F.size("l_phones") > 0) & (F.size("r_phones") > 0) & F.col("met").isNull(), item("phone_conflict", -12, CONFLICT)),
        F.when(both("site") & ~same("site"), item("domain_conflict", -20, CONFLICT)),
        F.when(both("mail_domain") & ~same("mail_domain") & no_phone, item("email_domain_conflict", -18, CONFLICT)),
    ]
    rows = rows.select("a", "b", F.array_compact(F.array(*rules)).alias("evidence"))
    any_of = lambda test: F.exists("evidence", test)
    raw = F.aggregate("evidence", F.lit(0), lambda acc, e: acc + e["weight"])
    raw = F.least(F.greatest(raw, F.lit(0)), F.lit(100))
    anchor = any_of(lambda e: (e["key"] == "email_alias") | (e["key"].isin("exact_email", "phone") & (e["tone"] == STRONG)))
    rows = rows.where(any_of(lambda e: e["weight"] > 0)).withColumn("score", F.when(anchor, raw).otherwise(F.least(raw, F.lit(69))))
    high = (F.col("score") >= 95) & any_of(lambda e: (e["tone"] == STRONG) & (e["weight"] > 0)) & ~any_of(lambda e: e["tone"] == CONFLICT)
    return cut(rows.where("score >= 60").withColumn("band", F.when(high, "high_confidence").when(F.col("score") >= 75, "review").otherwise("possible")).select("a", "b", "score", "band", "evidence"))


def _grow(pairs: pd.DataFrame) -> Iterator[list[str]]:
    """The clusters of one component's pairs of 75 or more, taken by score: a record joins the first cluster of its partner whose members all score 75 with it."""
    scores = {frozenset(p) for p in pairs[["a", "b"]].itertuples(index=False)}
    clusters: list[set[str]] = []
    of: dict[str, list[int]] = {}
    for a, b in pairs.sort_values(["score", "a", "b"], ascending=[False, True, True])[["a", "b"]].itertuples(index=False):
        mine, theirs = of.get(a, []), of.get(b, [])
        if any(b in clusters[i] for i in mine):
            continue
        for i in dict.fromkeys([*mine, *theirs]):
            new = b if a in clusters[i] else a
            if all(frozenset((k, new)) in scores for k in clusters[i]):
                clusters[i].add(new)
                of.setdefault(new, []).append(i)
                break
        else:
            clusters.append({a, b})
            for k in (a, b):
                of.setdefault(k, []).append(len(clusters) - 1)
    yield from map(sorted, clusters)


def component_labels(pairs: DataFrame) -> DataFrame:
    """(id, label) of the pairs' nodes, by smallest-label rounds with pointer jumps until nothing changes; each round is checkpointed."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    both = cut(both.unionByName(both.select("u", F.col("u").alias("v"))).distinct())
    at = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")))
    while True:
        near = both.join(at, both["v"] == at["id"]).groupBy("u").agg(F.min("label").alias("m"))
        jump = near.alias("x").join(at.alias("y"), F.col("x.m") == F.col("y.id")).select(F.col("x.u").alias("id"), F.least("x.m", "y.label").alias("label"))
        new = cut(jump)
        if new.join(at, ["id", "label"], "left_anti").isEmpty():
            return new
        at = new


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster_id, cluster_key, record_key, size, confidence, band), cut: cliques of the scored pairs. cluster_key is a digest of all members, cluster_id its 32-bit display form, which may repeat."""
    sure = pairs.where("score >= 75").select("a", "b", "score")
    degree = sure.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    sided = cut(sure.join(degree.withColumnsRenamed({"id": "a", "d": "da"}), "a").join(degree.withColumnsRenamed({"id": "b", "d": "db"}), "b"))
    alone = sided.where("da = 1 AND db = 1").select(F.sort_array(F.array("a", "b")).alias("members"))
    tangled = sided.where("da > 1 OR db > 1").drop("da", "db")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"members": list(_grow(pdf))})

    found = alone
    if not tangled.isEmpty():
        labels = component_labels(tangled)
        found = alone.union(tangled.join(labels, tangled["a"] == labels["id"]).groupBy("label").applyInPandas(run, "members array<string>"))
    strong = cut(found)
    # a weaker pair makes a cluster of two if it is the first of all that touch a record which has none yet
    placed = strong.select(F.explode("members").alias("id")).distinct()
    weak = pairs.where("score < 75").select("a", "b", "score")
    touched = weak.select(F.struct((-F.col("score")).alias("s"), "a", "b").alias("at"), F.explode(F.array("a", "b")).alias("id")).join(placed, "id", "left_anti")
    twos = touched.groupBy("id").agg(F.min("at").alias("at")).select("at.a", "at.b").distinct().select(F.sort_array(F.array("a", "b")).alias("members"))
    named = strong.union(twos).withColumn("joined", F.array_join("members", "|")).select(T.fnv1a(F.col("joined")).alias("cluster_id"), F.md5(F.col("joined").cast("binary")).alias("cluster_key"), "members")
    rows = cut(named.select("cluster_id", "cluster_key", F.size("members").cast("long").alias("size"), F.explode("members").alias("record_key")))
    x, y = rows.select("cluster_key", F.col("record_key").alias("a")), rows.select("cluster_key", F.col("record_key").alias("b"))
    inside = pairs.select("a", "b", "score", "band").join(x, "a").join(y, ["cluster_key", "b"])
    conf = inside.groupBy("cluster_key").agg(F.min("score").alias("confidence"), F.count_if(F.col("band") != "high_confidence").alias("weak"))
    shared = rows.groupBy("record_key").agg(F.count("*").alias("in"))
    mixed = rows.join(shared, "record_key").groupBy("cluster_key").agg(F.max("in").alias("in"), F.count_if(F.col("record_key").startswith("lead:")).alias("leads"))
    out = rows.join(conf, "cluster_key").join(mixed, "cluster_key")
    capped = (F.col("in") > 1) | ((F.col("leads") > 0) & (F.col("leads") < F.col("size")))
    band = F.when((F.col("confidence") >= 95) & (F.col("weak") == 0) & ~capped, "high_confidence").when(F.col("confidence") >= 75, "review").otherwise("possible")
    return cut(out.select("cluster_id", "cluster_key", "record_key", "size", "confidence", band.alias("band")))


def survivors(members: DataFrame, records: DataFrame) -> DataFrame:
    """Each cluster's survivor with its blank fields filled from the first member, by record key, that has them.

    The greatest score survives, then the oldest (created_at, if there is such a column), then the smallest record key; in a cluster of
    leads and contacts a contact survives before any lead."""
    fields = [c for c in FIELDS if c in records.columns]
    rows = members.select("cluster_key", "cluster_id", "record_key").join(records, "record_key")
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    filled = sum((there(c).cast("int") for c in fields), F.lit(0))
    mail = T.email(F.col("email"), strip_www=True)
    local = F.substring_index(mail, "@", 1)
    stale = F.coalesce(local.rlike(STALE), F.lit(False)) | F.coalesce(F.lower("job_title").rlike(r"\b(archive|former|inactive|old|previous)\b"), F.lit(False))
    score = filled * 5 + F.when(F.col("object_type") == "contact", 8).otherwise(0) + F.when(mail.isNotNull(), 8).otherwise(0) + F.when(mail.isNotNull() & ~local.contains("+"), 3).otherwise(0) - F.when(stale, 14).otherwise(0)
    created = F.col("created_at").cast("timestamp") if "created_at" in records.columns else F.lit(None).cast("timestamp")
    never = F.lit("9999-12-31").cast("timestamp")
    place = F.struct((F.col("object_type") != "contact").cast("int").alias("lead"), (-score).alias("score"), F.coalesce(created, never).alias("created"), F.col("record_key").alias("key"))
    first_with = {c: F.min_by(F.struct(F.trim(c).alias("v")), F.when(there(c), F.col("record_key"))) for c in fields}
    # no window: the survivor and the first holder of each field are smallest values, summed before the shuffle
    best = rows.groupBy("cluster_key", "cluster_id").agg(F.min(place).alias("by_contact"), F.min(F.struct(place["score"].alias("score"), place["created"].alias("created"), place["key"].alias("key"))).alias("by_score"), F.countDistinct("object_type").alias("kinds"), *(v["v"].alias(f"f_{c}") for c, v in first_with.items()))
    kept = F.when(F.col("kinds") > 1, F.col("by_contact.key")).otherwise(F.col("by_score.key"))
    points = F.when(F.col("kinds") > 1, F.col("by_contact.score")).otherwise(F.col("by_score.score"))
    best = best.select("cluster_key", "cluster_id", kept.alias("survivor"), (-points).alias("survivor_score"), *(F.col(f"f_{c}") for c in fields))
    own = records.select(F.col("record_key").alias("survivor"), *(F.trim(c).alias(c) for c in fields))
    return best.join(own, "survivor").select("cluster_id", "survivor", "survivor_score", *(F.coalesce(F.when(there(c), F.col(c)), F.col(f"f_{c}"), F.lit("")).alias(c) for c in fields))


def review_summary(members: DataFrame) -> DataFrame:
    """Clusters and records by band."""
    return members.groupBy("band").agg(F.countDistinct("cluster_key").alias("clusters"), F.countDistinct("record_key").alias("records"))
