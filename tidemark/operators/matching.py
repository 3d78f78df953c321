"""Incoming people matched with existing records: keys, caps, evidence, the three best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators.ranks import ranked
from tidemark.plans.lineage import cut

# Records of a broad key, candidates of an input, kept ones, uses of a phone that may be a key, fields to match on.
BROAD, MOST, KEPT, PHONE_USES = 250, 1000, 3, 3
FIELDS = ("email", "name", "phone", "state", "company")
# Codes and names of US states.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}


def state(raw: Column) -> Column:
    """A state's or region's normal form: compatibility forms folded, without dots, US names as codes, lower; null without a letter."""
    text = F.trim(F.regexp_replace(F.replace(F.lower(T.nfkc(T.not_placeholder(raw))), F.lit("."), F.lit("")), r"\s+", " "))
    codes = F.create_map(*(F.lit(x.lower()) for code, name in STATES.items() for x in (name, code)))
    return F.when(text.rlike(r"\p{L}"), F.coalesce(codes[text], text))


def prepared(df: DataFrame, id_col: str) -> DataFrame:
    """id, name (two words with letters or more), emails and phones as sets, company, state in normal form, cut. additional_emails, secondary_phone and state may lack."""
    blank = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in df.columns else blank
    full = T.name(T.not_placeholder(F.col("full_name")))
    lettered = F.size(F.filter(F.split(full, " "), lambda w: w.rlike(r"\p{L}"))) > 1
    some = lambda *c: F.array_distinct(F.array_compact(F.array(*c)))
    phone = lambda c: T.phone(T.not_placeholder(col(c)))
    more = F.col("additional_emails") if "additional_emails" in df.columns else F.array().cast("array<string>")
    rows = df.select(F.col(id_col).alias("id"), F.when(lettered, full).alias("name"), T.email(col("email"), True).alias("email"), some(phone("phone"), phone("secondary_phone")).alias("phones"), T.company(T.not_placeholder(col("company"))).alias("company"), state(col("state")).alias("state"), more.alias("more"))
    if "additional_emails" in df.columns:  # each of them in normal form, which can't run inside an array
        others = rows.select("id", F.explode("more").alias("e")).select("id", T.email(F.col("e"), True).alias("e")).where("e IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("e")).alias("others"))
        rows = rows.join(others, "id", "left")
    else:
        rows = rows.withColumn("others", F.array().cast("array<string>"))
    emails = F.array_distinct(F.concat(F.array_compact(F.array("email")), F.coalesce("others", F.array().cast("array<string>"))))
    return cut(rows.select("id", "name", T.numbered_bigrams(F.col("name")).alias("name_pairs"), emails.alias("emails"), "phones", "company", "state"))


def keys_of(n: DataFrame, uses: DataFrame | None, fields: tuple[str, ...] = FIELDS, own: int = 0) -> DataFrame:
    """(id, key): emails, phones of PHONE_USES uses at most (own: uses that are the row's own; uses None: all phones), name, initials and surname in a context, company of those with an email."""
    c, on = F.col, set(fields)
    out = n
    if uses is None:
        rare = c("phones")
    else:
        each = n.select("id", F.explode("phones").alias("phone")).join(uses, "phone", "left").where(F.coalesce("uses", F.lit(0)) - own <= PHONE_USES)
        out = n.join(each.groupBy("id").agg(F.collect_set("phone").alias("__rare")), "id", "left")
        rare = F.coalesce("__rare", F.array().cast("array<string>"))
    with_prefix = lambda p, values: F.transform(values, lambda v: F.concat(F.lit(p), v))
    one = lambda v: F.array_compact(F.array(v))
    none = F.array().cast("array<string>")
    first, last = F.split_part("name", F.lit(" "), F.lit(1)), F.substring_index("name", " ", -1)
    contexts = [with_prefix("state:", one(c("state")))] * ("state" in on) + [with_prefix("company:", one(c("company")))] * ("company" in on) + [with_prefix("phone:", c("phones"))] * ("phone" in on) + [F.transform("emails", lambda e: F.concat(F.lit("domain:"), F.substring_index(e, "@", -1)))] * ("email" in on)
    around = F.concat(none, *contexts)
    keys = [with_prefix("email:", c("emails"))] * ("email" in on) + [with_prefix("phone:", rare)] * ("phone" in on)
    if "name" in on:
        named = lambda head: F.transform(around, lambda x: F.concat(head, F.lit(":"), x))
        initials = F.concat(F.lit("initials:"), F.substring(first, 1, 1), F.lit(":"), F.substring(last, 1, 1))
        keys += [F.when(c("name").isNotNull(), F.concat(with_prefix("name:", one(c("name"))), named(initials), named(F.concat(F.lit("surname:"), last)))).otherwise(none)]
    if {"email", "company"} <= on:
        keys.append(F.when(F.size("emails") > 0, with_prefix("email-company:", one(c("company")))).otherwise(none))
    return out.select("id", F.explode(F.array_distinct(F.concat(none, *keys))).alias("key"))


def evidence(l, r, fields: tuple[str, ...] = FIELDS) -> Column:
    """Array of (key, weight) of two prepared sides. Columns met_phone (uses, phone), met_email and near_email say what they share."""
    on = set(fields)
    both = lambda c: l(c).isNotNull() & r(c).isNotNull()
    sets = lambda c: (F.size(l(c)) > 0) & (F.size(r(c)) > 0)
    same = lambda c: F.coalesce(l(c) == r(c), F.lit(False)) & F.lit(c in on)
    item = lambda k, w: F.struct(F.lit(k).alias("key"), F.lit(w).alias("weight"))
    mail, uses = F.col("met_email"), F.col("met_phone.uses")
    generic = F.replace(F.substring_index(F.substring_index(mail, "@", 1), "+", 1), F.lit("."), F.lit("")).isin(*T.GENERIC_INBOXES)
    similar = F.lit("name" in on) & both("name") & ~same("name") & (F.col("name_like") >= 0.82)
    typo = F.col("near_email") & (same("name") | similar | same("company") | F.coalesce(uses == 1, F.lit(False)))
    rules = {
        "email": F.when(sets("emails"), F.when(mail.isNotNull(), F.when(generic, item("role_email", 25)).otherwise(item("exact_email", 90))).when(typo, item("email_typo", 30)).otherwise(item("email_conflict", -22))),
        "name": F.when(both("name"), F.when(same("name"), item("name", 32)).when(similar, item("name_similar", 24)).otherwise(item("name_conflict", -32))),
        "phone": F.when(sets("phones"), F.when(uses.isNotNull(), F.when(uses == 1, item("unique_phone", 44)).when(uses <= PHONE_USES, item("phone", 30)).otherwise(item("shared_phone", 8))).otherwise(item("phone_conflict", -14))),
        "state": F.when(both("state"), F.when(same("state"), item("state", 6)).otherwise(item("state_conflict", -6))),
        "company": F.when(both("company"), F.when(same("company"), item("company", 12)).otherwise(item("company_conflict", -8))),
    }
    return F.array_compact(F.array(*(v for k, v in rules.items() if k in on)))


def _looked_at(a: DataFrame, b: DataFrame, fields: tuple[str, ...], exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """(input_id, record_id, key, n, email) of all keys that inputs and records share, n without the input's own row, and uses of phones."""
    uses = b.select(F.explode("phones").alias("phone")).groupBy("phone").agg(F.count("*").alias("uses"))
    own = 1 if exclude_self else 0
    theirs = cut(keys_of(b, None if exclude_self else uses, fields))
    sizes = theirs.groupBy("key").agg(F.count("*").alias("n")).withColumn("n", F.col("n") - own)
    hot = sizes.where(F.col("key").startswith("email:") & (F.col("n") > MOST)).select("key")
    if not hot.isEmpty():  # an input looks at no more than MOST records, by id inside a key: of an email that more share, the first are enough (and one more, to tell that there are)
        first = ranked(theirs.join(hot, "key", "left_semi"), ["key"], [F.asc("id")], "__nth").where(F.col("__nth") <= MOST + 1 + own).drop("__nth")
        theirs = theirs.join(hot, "key", "left_anti").unionByName(first)
    met = keys_of(a, uses, fields, own).withColumnRenamed("id", "input_id").join(sizes, "key").withColumn("email", F.col("key").startswith("email:"))
    narrow = met.where("email OR n <= " + str(BROAD)).join(theirs.withColumnRenamed("id", "record_id"), "key")
    if exclude_self:
        narrow = narrow.where("input_id <> record_id")
    return narrow, met.where(~F.col("email") & (F.col("n") > BROAD))


def match_people(inputs: DataFrame, existing: DataFrame, input_id: str = "contact_id", existing_id: str = "record_key", exclude_self: bool = False, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(input_id, record_id, score, rank, evidence): up to three candidates per input.

    Existing keys of more than BROAD records (but emails) are skipped; an input looks at no more than MOST candidates, email keys and
    smaller keys first. Both limits are part of the rules; ``match_warnings`` tells where they were met. exclude_self: the inputs are the records; none is matched
    with its own id, and its own phone and keys don't count.
    """
    a, b = prepared(inputs, input_id), prepared(existing, existing_id)
    met, _ = _looked_at(a, b, fields, exclude_self)
    first = met.groupBy("input_id", "record_id").agg(F.min(F.struct((~F.col("email")).cast("int").alias("k"), F.col("n"), F.col("key"))).alias("at"))
    order = Window.partitionBy("input_id").orderBy("at", "record_id")
    pairs = cut(first.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= MOST).select("input_id", "record_id"))
    side = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in d.columns))
    rows = pairs.join(side(a, "l"), F.col("input_id") == F.col("l_id")).join(side(b, "r"), F.col("record_id") == F.col("r_id"))
    # of several shared phones the rarest one counts
    uses = b.select(F.explode("phones").alias("phone")).groupBy("phone").agg(F.count("*").alias("uses"))
    shared = rows.select("input_id", "record_id", F.explode(F.array_intersect("l_phones", "r_phones")).alias("phone")).join(uses, "phone")
    shared = shared.groupBy("input_id", "record_id").agg(F.min(F.struct((F.col("uses") - int(exclude_self)).alias("uses"), "phone")).alias("met_phone"))
    rows = rows.join(shared, ["input_id", "record_id"], "left").withColumn("met_email", F.get(F.array_intersect("l_emails", "r_emails"), F.lit(0)))
    near = F.exists("l_emails", lambda x: F.exists("r_emails", lambda y: F.coalesce(T.email_typo(x, y), F.lit(False))))
    rows = rows.withColumns({"name_like": T.numbered_dice(F.col("l_name"), F.col("r_name"), F.col("l_name_pairs"), F.col("r_name_pairs")), "near_email": F.when(F.col("met_email").isNotNull(), False).otherwise(near)})
    rows = rows.withColumn("evidence", evidence(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"), fields))
    has = lambda *k: F.exists("evidence", lambda e: e["key"].isin(*k))
    corroborated = has("name_similar") & has("state", "company", "unique_phone", "phone", "shared_phone", "email_typo")
    useful = has("exact_email", "role_email", "unique_phone", "phone", "name", "email_typo") | corroborated
    plus = F.aggregate("evidence", F.lit(0), lambda s, e: s + F.greatest(e["weight"], F.lit(0)))
    minus = F.aggregate("evidence", F.lit(0), lambda s, e: s + F.least(e["weight"], F.lit(0)))
    top = F.when(has("exact_email", "unique_phone"), 100).otherwise(69)
    rows = rows.where(useful).withColumn("score", F.greatest(F.least(plus, top) + minus, F.lit(0))).where((F.col("score") >= 28) | has("exact_email", "role_email"))
    best = Window.partitionBy("input_id").orderBy(F.desc("score"), "record_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= KEPT).select("input_id", "record_id", "score", "rank", F.array_join(F.transform("evidence", lambda e: e["key"]), "|").alias("evidence"))


def match_warnings(inputs: DataFrame, existing: DataFrame, input_id: str = "contact_id", existing_id: str = "record_key", exclude_self: bool = False, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(input_id, skipped_keys, capped, incomplete): where the limits of ``match_people`` leave a result open."""
    a, b = prepared(inputs, input_id), prepared(existing, existing_id)
    met, broad = _looked_at(a, b, fields, exclude_self)
    skipped = broad.groupBy("input_id").agg(F.count("*").alias("skipped_keys"))
    capped = met.groupBy("input_id").agg((F.countDistinct("record_id") > MOST).alias("capped"))
    out = a.select(F.col("id").alias("input_id")).join(skipped, "input_id", "left").join(capped, "input_id", "left").fillna(0, ["skipped_keys"]).fillna(False, ["capped"])
    return out.withColumn("incomplete", F.col("capped") | (F.col("skipped_keys") > 0))


def match_fields(inputs: DataFrame) -> DataFrame:
    """How many inputs have each field, for choosing what to match on."""
    n = prepared(inputs, inputs.columns[0])
    there = {"email": F.size("emails") > 0, "name": F.col("name").isNotNull(), "phone": F.size("phones") > 0, "state": F.col("state").isNotNull(), "company": F.col("company").isNotNull()}
    counts = n.agg(*(F.count_if(v).alias(c) for c, v in there.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in FIELDS))).alias("x")).select("x.*")
