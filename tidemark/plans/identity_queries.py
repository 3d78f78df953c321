"""Registered identity and matching queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.operators import matching as M
from tidemark.sources.views import people


def _inputs(s, d):
    """Leads as incoming rows."""
    p = people(s, d).where("object_type = 'lead'")
    return p.select(F.col("record_key").alias("contact_id"), F.concat_ws(" ", "first_name", "last_name").alias("full_name"), "email", "phone", "company")


def _existing(s, d):
    p = people(s, d).where("object_type = 'contact'")
    return p.select("record_key", F.concat_ws(" ", "first_name", "last_name").alias("full_name"), "email", "phone", "company")


def _clusters(s, d):
    return I.clusters(I.scored_pairs(I.normalized(people(s, d))))


QUERIES = {
    "identity_candidates": lambda s, d: I.candidate_pairs(I.normalized(people(s, d))),
    "identity_pairs": lambda s, d: I.scored_pairs(I.normalized(people(s, d))).select("a", "b", "score", "band", F.array_join(F.transform("evidence", lambda e: e["key"]), "|").alias("evidence")),
    "identity_clusters": lambda s, d: _clusters(s, d).drop("cluster_key"),
    "identity_survivors": lambda s, d: I.survivors(_clusters(s, d), people(s, d)),
    "identity_review": lambda s, d: I.review_summary(_clusters(s, d)),
    "phone_frequency": lambda s, d: I.normalized(people(s, d)).select(F.explode("phones.phone").alias("phone")).groupBy("phone").agg(F.count("*").alias("n")),
    "import_matches": lambda s, d: M.match_people(_inputs(s, d), _existing(s, d)),
    "import_warnings": lambda s, d: M.match_warnings(_inputs(s, d), _existing(s, d)),
    "import_match_fields": lambda s, d: M.match_fields(_inputs(s, d)),
}
_PEOPLE = """kinds AS (SELECT c_custkey k, 'contact' kind FROM customer UNION ALL SELECT s_suppkey, 'lead' FROM supplier),
p AS (SELECT kind || ':' || k record_key, kind object_type, k, (['ada','bruno','cyrus','diana','edgar','fay','gus'])[k % 7 + 1] first, lower((['morgan','keller','lindqvist','okafor'])[k % 4 + 1] || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij')) last,
 CASE WHEN k % 6 = 5 THEN NULL WHEN kind = 'lead' AND k % 3 = 0 THEN 'p.' || k || '+x@gmail.com' WHEN k % 3 = 0 THEN 'p' || k || '@gmail.com' ELSE 'p' || k || '@corp' || (k % 30) || '.example' END email,
 CASE WHEN k % 10 = 9 THEN NULL ELSE CAST(k % 30 AS VARCHAR) END company,
 CASE WHEN k % 4 = 0 THEN '1412555' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') WHEN k % 4 = 1 THEN '1412556' || lpad(CAST((k // 100) % 10000 AS VARCHAR), 4, '0') END phone,
 CASE WHEN k % 5 = 0 THEN 'corp' || (k % 30) || '.example' END site FROM kinds),
n AS (SELECT *, first || ' ' || last AS name, CASE WHEN email LIKE '%@gmail.com' THEN replace(split_part(split_part(email, '@', 1), '+', 1), '.', '') || '@gmail.com' ELSE email END alias, split_part(email, '@', 2) dom, count(*) OVER (PARTITION BY phone) uses FROM p),
k AS (SELECT DISTINCT * FROM (SELECT record_key, unnest(['email','alias','phone','name-company','name-domain','surname-domain','loose']) kind, unnest([email, alias, CASE WHEN uses <= 3 THEN phone END, name || ':' || company, name || ':' || site, last || ':' || dom, company || ':' || first[1] || ':' || last[1]]) AS key FROM n) WHERE key IS NOT NULL),
z AS (SELECT kind, key, count(*) n, min(record_key) f FROM k GROUP BY 1, 2 HAVING count(*) > 1 AND (kind IN ('email','alias') OR count(*) <= 100)),
u AS (SELECT k.*, n, f FROM k JOIN z USING (kind, key)),
pairs AS (SELECT DISTINCT a, b FROM (SELECT x.record_key a, y.record_key b FROM u x JOIN u y USING (kind, key) WHERE x.n <= 500 AND x.record_key < y.record_key UNION ALL SELECT f, record_key FROM u WHERE n > 500 AND record_key <> f))"""
_bigrams = lambda x: f"list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2))"
_dice = lambda x, y, bx, by: f"CASE WHEN {x} = {y} THEN 1.0 WHEN len({bx}) = 0 OR len({by}) = 0 THEN CASE WHEN {x}[1] = {y}[1] THEN 0.6 ELSE 0.0 END ELSE 2.0 * list_sum(list_transform(list_distinct({bx}), lambda g: least(len(list_filter({bx}, lambda v: v = g)), len(list_filter({by}, lambda v: v = g))))) / (len({bx}) + len({by})) END"
_PAIRS = f"""{_PEOPLE}, g AS (SELECT *, {_bigrams('first')} bf, {_bigrams('last')} bl FROM n),
j AS (SELECT a, b, {', '.join(f'l.{c} l_{c}, r.{c} r_{c}' for c in ('email', 'alias', 'phone', 'uses', 'name', 'first', 'last', 'company', 'site', 'dom'))}, {_dice('l.first', 'r.first', 'l.bf', 'r.bf')} df, {_dice('l.last', 'r.last', 'l.bl', 'r.bl')} dl FROM pairs JOIN g l ON a = l.record_key JOIN g r ON b = r.record_key),
f AS (SELECT *, l_first = r_first OR (l_first[1] = r_first[1] AND df >= 0.55) fits FROM j),
e AS (SELECT a, b, list_filter([
 CASE WHEN l_email = r_email THEN {{'k': 'exact_email', 'w': 96, 't': 's'}} WHEN l_alias = r_alias THEN {{'k': 'email_alias', 'w': CASE WHEN l_alias LIKE '%@gmail.com' THEN 72 ELSE 55 END, 't': 'u'}} END,
 CASE WHEN l_phone = r_phone THEN CASE WHEN l_uses > 3 THEN {{'k': 'phone', 'w': 16, 't': 'w'}} ELSE {{'k': 'phone', 'w': 54, 't': 's'}} END END,
 CASE WHEN l_name = r_name THEN {{'k': 'name', 'w': 34, 't': 's'}} WHEN dl >= 0.82 AND fits THEN {{'k': 'name_compatible', 'w': 22, 't': 'u'}} END,
 CASE WHEN l_company = r_company THEN {{'k': 'company', 'w': 18, 't': 'u'}} END,
 CASE WHEN l_site = r_site THEN {{'k': 'website_domain', 'w': 20, 't': 'u'}} END,
 CASE WHEN l_dom = r_dom AND l_dom <> 'gmail.com' THEN {{'k': 'email_domain', 'w': 8, 't': 'u'}} END,
 CASE WHEN dl < 0.55 THEN {{'k': 'last_name_conflict', 'w': -38, 't': 'c'}} END,
 CASE WHEN NOT fits THEN {{'k': 'first_name_conflict', 'w': -22, 't': 'c'}} END,
 CASE WHEN l_phone <> r_phone THEN {{'k': 'phone_conflict', 'w': -12, 't': 'c'}} END,
 CASE WHEN l_site <> r_site THEN {{'k': 'domain_conflict', 'w': -20, 't': 'c'}} END,
 CASE WHEN l_dom <> r_dom AND l_phone IS NULL AND r_phone IS NULL THEN {{'k': 'email_domain_conflict', 'w': -18, 't': 'c'}} END], lambda x: x IS NOT NULL) ev FROM f),
w AS (SELECT *, least(greatest(list_sum(list_transform(ev, lambda x: x.w)), 0), 100) raw, len(list_filter(ev, lambda x: x.k = 'email_alias' OR (x.k IN ('exact_email', 'phone') AND x.t = 's'))) > 0 anchor FROM e WHERE len(list_filter(ev, lambda x: x.w > 0)) > 0),
sp AS (SELECT a, b, CAST(CASE WHEN anchor THEN raw ELSE least(raw, 69) END AS INTEGER) score, ev FROM w),
scored AS (SELECT a, b, score, CASE WHEN score >= 95 AND len(list_filter(ev, lambda x: x.t = 's' AND x.w > 0)) > 0 AND len(list_filter(ev, lambda x: x.t = 'c')) = 0 THEN 'high_confidence' WHEN score >= 75 THEN 'review' ELSE 'possible' END band, array_to_string(list_transform(ev, lambda x: x.k), '|') evidence FROM sp WHERE score >= 60)"""
#: Strong pairs of these tables stand alone, so a strong pair is a cluster; a test holds larger cliques against brute force.
_CLUSTERS = f"""{_PAIRS}, strong AS (SELECT a, b FROM scored WHERE score >= 75),
held AS (SELECT a k FROM strong UNION SELECT b FROM strong),
touch AS (SELECT a, b, score, unnest([a, b]) k FROM scored WHERE score < 75),
firsts AS (SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, a, b) r FROM touch WHERE k NOT IN (SELECT k FROM held)) WHERE r = 1),
c2 AS (SELECT s.a, s.b, s.score, s.band FROM scored s JOIN (SELECT * FROM strong UNION SELECT * FROM firsts) USING (a, b)),
mem AS (SELECT a || '|' || b joined, score, band, unnest([a, b]) record_key FROM c2),
shared AS (SELECT record_key, count(*) n FROM mem GROUP BY 1),
cl AS (SELECT joined, max(score) confidence, max(band) band, max(n) > 1 OR count(DISTINCT split_part(record_key, ':', 1)) > 1 capped FROM mem JOIN shared USING (record_key) GROUP BY 1),
clusters AS (SELECT printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(joined, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)) cluster_id, joined, record_key, CAST(2 AS BIGINT) size, confidence, CASE WHEN confidence >= 95 AND cl.band = 'high_confidence' AND NOT capped THEN 'high_confidence' WHEN confidence >= 75 THEN 'review' ELSE 'possible' END band FROM cl JOIN (SELECT joined, record_key FROM mem) USING (joined))"""
_RAW = """raw AS (SELECT record_key, object_type, (['Ada','Bruno','Cyrus','Diana','Edgar','Fay','Gus'])[k % 7 + 1] first_name, (['Morgan','Keller','Lindqvist','Okafor'])[k % 4 + 1] || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') last_name, coalesce(email, '') email,
 CASE WHEN company IS NULL THEN '' ELSE 'Corp ' || company || CASE WHEN object_type = 'lead' THEN ' Inc.' ELSE '' END END company, CASE WHEN k % 4 = 0 THEN '+1 412 555 ' || phone[8:] WHEN k % 4 = 1 THEN '412-556-' || phone[8:] ELSE '' END phone,
 CASE WHEN k % 5 = 0 THEN 'https://www.corp' || (k % 30) || '.example/about' ELSE '' END website, CASE WHEN object_type = 'lead' THEN '' ELSE 'Analyst' END job_title FROM n)"""
_fields = ("first_name", "last_name", "email", "company", "phone", "job_title", "website")
_SURVIVORS = f"""{_CLUSTERS}, {_RAW}, sc AS (SELECT cluster_id, joined, raw.*, 5 * ({' + '.join(f"CAST({c} <> '' AS INTEGER)" for c in _fields)}) + CASE WHEN object_type = 'contact' THEN 8 ELSE 0 END + CASE WHEN email <> '' THEN 8 ELSE 0 END + CASE WHEN email <> '' AND email NOT LIKE '%+%' THEN 3 ELSE 0 END points FROM clusters JOIN raw USING (record_key)),
od AS (SELECT *, row_number() OVER (PARTITION BY joined ORDER BY CASE WHEN kinds > 1 AND object_type <> 'contact' THEN 1 ELSE 0 END, points DESC, record_key) r FROM (SELECT *, count(DISTINCT object_type) OVER (PARTITION BY joined) kinds FROM sc))
SELECT cluster_id, max(CASE WHEN r = 1 THEN record_key END) survivor, max(CASE WHEN r = 1 THEN points END) survivor_score, {', '.join(f"coalesce(nullif(max(CASE WHEN r = 1 THEN {c} END), ''), arg_min({c}, record_key) FILTER (WHERE {c} <> ''), '') {c}" for c in _fields)} FROM od GROUP BY joined, cluster_id"""
_typo = lambda x, y: f"(length({x}) >= 5 AND length({y}) >= 5 AND damerau_levenshtein({x}, {y}) = 1)"
_MATCHES = f"""{_PEOPLE}, q AS (SELECT *, count(*) FILTER (WHERE object_type = 'contact') OVER (PARTITION BY phone) pu FROM n),
v AS (SELECT *, {_bigrams('replace(name, chr(32), $$$$)')} bn, list_distinct(list_filter([ 'email:' || email, CASE WHEN pu <= 3 THEN 'phone:' || phone END, 'name:' || name, CASE WHEN email IS NOT NULL THEN 'email-company:' || company END] || list_transform(list_filter(['company:' || company, 'phone:' || phone, 'domain:' || dom], lambda x: x IS NOT NULL), lambda x: 'initials:' || first[1] || ':' || last[1] || ':' || x) || list_transform(list_filter(['company:' || company, 'phone:' || phone, 'domain:' || dom], lambda x: x IS NOT NULL), lambda x: 'surname:' || last || ':' || x), lambda x: x IS NOT NULL)) keys FROM q),
kl AS (SELECT record_key i, unnest(keys) AS key FROM v WHERE object_type = 'lead'), kr AS (SELECT record_key r, unnest(keys) AS key FROM v WHERE object_type = 'contact'),
kz AS (SELECT key FROM kr GROUP BY 1 HAVING count(*) <= 250 OR key LIKE 'email:%'),
mp AS (SELECT DISTINCT i, r FROM kl JOIN kz USING (key) JOIN kr USING (key)),
mj AS (SELECT i, r, {', '.join(f'l.{c} l_{c}, r.{c} r_{c}' for c in ('email', 'phone', 'name', 'company'))}, r.pu uses, split_part(l.email, '@', 1) ll, split_part(r.email, '@', 1) rl, l.dom ld, r.dom rd, {_dice('l.name', 'r.name', 'l.bn', 'r.bn')} dn FROM mp JOIN v l ON i = l.record_key JOIN v r ON mp.r = r.record_key),
mk AS (SELECT *, l_name <> r_name AND dn >= 0.82 AS alike, NOT contains(l_email, '+') AND NOT contains(r_email, '+') AND ((ld = rd AND {_typo('ll', 'rl')}) OR (ll = rl AND damerau_levenshtein(ld, rd) = 1)) near FROM mj),
me AS (SELECT i, r, list_filter([
 CASE WHEN l_email IS NOT NULL AND r_email IS NOT NULL THEN CASE WHEN l_email = r_email THEN {{'k': 'exact_email', 'w': 90}} WHEN near AND (l_name = r_name OR alike OR coalesce(l_company = r_company, false) OR coalesce(l_phone = r_phone AND uses = 1, false)) THEN {{'k': 'email_typo', 'w': 30}} ELSE {{'k': 'email_conflict', 'w': -22}} END END,
 CASE WHEN l_name = r_name THEN {{'k': 'name', 'w': 32}} WHEN alike THEN {{'k': 'name_similar', 'w': 24}} ELSE {{'k': 'name_conflict', 'w': -32}} END,
 CASE WHEN l_phone = r_phone THEN CASE WHEN uses = 1 THEN {{'k': 'unique_phone', 'w': 44}} WHEN uses <= 3 THEN {{'k': 'phone', 'w': 30}} ELSE {{'k': 'shared_phone', 'w': 8}} END WHEN l_phone <> r_phone THEN {{'k': 'phone_conflict', 'w': -14}} END,
 CASE WHEN l_company = r_company THEN {{'k': 'company', 'w': 12}} WHEN l_company <> r_company THEN {{'k': 'company_conflict', 'w': -8}} END], lambda x: x IS NOT NULL) ev FROM mk),
mh AS (SELECT *, list_transform(ev, lambda x: x.k) ks FROM me),
ms AS (SELECT *, greatest(least(list_sum(list_transform(ev, lambda x: greatest(x.w, 0))), CASE WHEN list_has_any(ks, ['exact_email', 'unique_phone']) THEN 100 ELSE 69 END) + list_sum(list_transform(ev, lambda x: least(x.w, 0))), 0) score FROM mh WHERE list_has_any(ks, ['exact_email', 'unique_phone', 'phone', 'name', 'email_typo']) OR (list_contains(ks, 'name_similar') AND list_has_any(ks, ['company', 'unique_phone', 'phone', 'shared_phone', 'email_typo']))),
mr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, r) rank FROM ms WHERE score >= 28 OR list_contains(ks, 'exact_email'))"""
ORACLES = {
    "import_matches": f"WITH {_MATCHES} SELECT i input_id, r record_id, CAST(score AS INTEGER) score, CAST(rank AS INTEGER) rank, array_to_string(ks, '|') evidence FROM mr WHERE rank <= 3",
    "import_warnings": f"WITH {_MATCHES}, b AS (SELECT key FROM kr GROUP BY 1 HAVING count(*) > 250 AND key NOT LIKE 'email:%'), w AS (SELECT i, count(*) s FROM kl JOIN b USING (key) GROUP BY 1) SELECT record_key input_id, coalesce(s, 0) skipped_keys, false capped, coalesce(s, 0) > 0 incomplete FROM p LEFT JOIN w ON record_key = i WHERE object_type = 'lead'",
    "identity_pairs": f"WITH {_PAIRS} SELECT a, b, score, band, evidence FROM scored",
    "identity_clusters": f"WITH {_CLUSTERS} SELECT cluster_id, record_key, size, confidence, band FROM clusters",
    "identity_survivors": f"WITH {_SURVIVORS}",
    "identity_review": f"WITH {_CLUSTERS} SELECT band, count(DISTINCT joined) clusters, count(DISTINCT record_key) records FROM clusters GROUP BY 1",
    "identity_candidates": f"WITH {_PEOPLE} SELECT a, b FROM pairs",
    "phone_frequency": f"WITH {_PEOPLE} SELECT phone, count(*) n FROM p WHERE phone IS NOT NULL GROUP BY 1",
    "import_match_fields": f"WITH {_PEOPLE}, l AS (SELECT * FROM p WHERE object_type = 'lead') SELECT 'email' field, count(email) filled FROM l UNION ALL SELECT 'name', count(*) FROM l UNION ALL SELECT 'phone', count(phone) FROM l UNION ALL SELECT 'state', CAST(0 AS BIGINT) UNION ALL SELECT 'company', count(company) FROM l",
}
