"""DuckDB SQL of the queries that SQL can express. The others are held against brute force in tests/llm."""

from __future__ import annotations

from tidemark.llm import chat, mixing, quality, resampling, spelling

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _escaped(c: str) -> str:
    """Length of an escaped text: its own, one more for every backslash and for every start of a control string."""
    count = lambda s: f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}"
    return f"length({c}) + " + " + ".join(count(s) for s in ("\\", "<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"))


_frame = len(chat.OPEN) + len(chat.SEP) + len(chat.CLOSE)
OP3 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, {_frame} + {_escaped('role')} + {_escaped('text')} AS n FROM t)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
 CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) loss_sha256, CAST(sum(n) AS BIGINT) formatted_chars FROM n GROUP BY conv_id"""

_F = {"symbols": "n_symbols * 1000 // greatest(n_words, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)", "echoes": "n_echoes * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 100 // greatest(n_words, 1)"}
def _jump(k: str) -> str:
    """The first jump of a feature's upper quantiles."""
    u, g = quality.JUMPING[k], quality.GRID
    steps = " ".join(f"WHEN q{b} + {u} >= {quality.JUMP} * (q{a} + {u}) THEN CAST(floor(sqrt(CAST((q{a} + {u}) * (q{b} + {u}) AS DOUBLE))) AS BIGINT) - {u}" for a, b in zip(g, g[1:]))
    return f"max(CASE WHEN feature = '{k}' THEN CASE {steps} WHEN q75 = 0 THEN z90 + {quality.SPAN} * (z90 - z50) END END) {k}_high"


_fences = ", ".join([*map(_jump, quality.JUMPING), f"max(CASE WHEN feature = 'word_length' THEN q50 + {quality.REACH} * greatest(q75 - q50, q50 // 16) END) word_length_high", f"max(CASE WHEN feature = 'word_length' THEN q50 - {quality.REACH} * greatest(q50 - q25, q50 // 16) END) word_length_low"])
_verdict = " AND ".join([*(f"coalesce(f_{k} <= {k}_high, true)" for k in _F), "coalesce(f_word_length >= word_length_low, true)"])


def _quantiles(keys: str, only: str = "true") -> str:
    part = f"{keys}, feature" if keys else "feature"
    at = lambda p: f"min(CASE WHEN 100 * upto >= {p} * n THEN lo END) q{p}"
    return f"SELECT {part}, max(n) n, {', '.join(map(at, quality.PERCENTILES))} FROM (SELECT *, sum(c) OVER (PARTITION BY {part} ORDER BY bucket) upto, sum(c) OVER (PARTITION BY {part}) n FROM (SELECT {part}, bucket, min(lo) lo, sum(c) c FROM sk WHERE {only} GROUP BY {part}, bucket)) GROUP BY {part}"


_level = lambda q: f"CASE WHEN o.n >= {quality.MIN_GROUP} THEN o.{q} WHEN l.n >= {quality.MIN_GROUP} THEN l.{q} ELSE a.{q} END {q}"
OP4 = f"""WITH w AS (SELECT row_number() OVER () id, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM documents),
g AS (SELECT id, i, array_to_string(ws[i:i + 7], ' ') gram FROM (SELECT id, ws, unnest(range(1, len(ws) - 6)) i FROM w WHERE len(ws) >= 8)),
r AS (SELECT id, i FROM g QUALIFY count(*) OVER (PARTITION BY id, gram) > 1),
cov AS (SELECT id, CAST(sum(8 - greatest(0, coalesce(prev, -100) + 8 - i)) AS BIGINT) n FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) prev FROM r) GROUP BY id),
m AS (SELECT w.id, doc_id, lang, source, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, coalesce(cov.n, 0) n_repeat_words, len(ls) n_lines,
 len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) n_echoes FROM w LEFT JOIN cov ON cov.id = w.id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed, {', '.join(f'{v} f_{k}' for k, v in _F.items())} FROM m),
x AS (SELECT lang, source, unnest([{', '.join(f"'{k}'" for k in _F)}]) feature, unnest([{', '.join(f'CAST(f_{k} AS BIGINT)' for k in _F)}]) v FROM b WHERE NOT base_failed),
y AS (SELECT *, CASE WHEN v < 32 THEN 0 ELSE length(bin(v)) - 5 END s FROM x),
sk AS (SELECT lang, source, feature, CASE WHEN v < 32 THEN v ELSE s * 16 + (v >> s) END bucket, min((v >> s) << s) lo, count(*) c FROM y GROUP BY 1, 2, 3, 4),
o AS ({_quantiles('lang, source')}), l AS ({_quantiles('lang')}), a AS ({_quantiles('')}), zl AS ({_quantiles('lang', 'bucket > 0')}), za AS ({_quantiles('', 'bucket > 0')}),
q AS (SELECT o.lang, o.source, o.feature, {', '.join(_level(f'q{p}') for p in quality.PERCENTILES)}, {', '.join(f'CASE WHEN zl.n >= {quality.MIN_GROUP} THEN zl.q{p} WHEN za.n >= {quality.MIN_GROUP} THEN za.q{p} END z{p}' for p in (50, 90))}
 FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.feature = l.feature JOIN a ON o.feature = a.feature LEFT JOIN zl ON o.lang IS NOT DISTINCT FROM zl.lang AND o.feature = zl.feature LEFT JOIN za ON o.feature = za.feature),
t AS (SELECT lang, source, {_fences} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict} kept FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source"""

_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END sh FROM w),
e AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM s),
p AS (SELECT a.doc_id a, b.doc_id b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
d AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach(a, b) AS (SELECT a, b FROM d UNION SELECT reach.a, d.b FROM reach JOIN d ON reach.b = d.a),
c AS (SELECT a, min(b) b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) n_shingles, least(doc_id, coalesce(b, doc_id)) component_id, doc_id = least(doc_id, coalesce(b, doc_id)) kept FROM s LEFT JOIN c ON doc_id = a"""

_w = "(" + "[" + ",".join(map(str, mixing.WEIGHTS)) + f"])[k % {len(mixing.WEIGHTS)} + 1]"
OP10 = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) size, (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 k FROM d GROUP BY source),
c AS (SELECT *, {_w} w, source_size * {mixing.MOST} cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) done, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) w_open, sum(source_size) OVER () * {mixing.SHARE_PERCENT} total FROM c WINDOW o AS (ORDER BY cap / CAST(w AS DOUBLE), k)),
v AS (SELECT *, (total / 100.0::DOUBLE - CAST(done AS DOUBLE)) / CAST(w_open AS DOUBLE) lev FROM f),
z AS (SELECT arg_min(lev, cap / CAST(w AS DOUBLE) * 1e6 + k) lev FROM v WHERE lev <= cap / CAST(w AS DOUBLE)),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT lev FROM z) * w), CAST(cap AS DOUBLE)) target FROM v),
k AS (SELECT d.source, length(bin(greatest(size, 1))) cl, CAST(sum(size) AS BIGINT) words, any_value(target) target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
h AS (SELECT *, (target - {mixing.MOST} * CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY cl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / nullif(CAST(sum(words * cl) OVER (PARTITION BY source ORDER BY cl DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) lev FROM k),
l AS (SELECT source, arg_max(lev, cl) lev FROM h WHERE lev * cl <= {mixing.MOST} GROUP BY source),
m0 AS (SELECT d.*, source_size, target, CASE WHEN target > 0 THEN coalesce(least(lev * length(bin(greatest(size, 1))), {mixing.MOST}.0::DOUBLE), {mixing.MOST}.0::DOUBLE) ELSE 0.0::DOUBLE END m FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source),
m AS (SELECT * REPLACE (CASE WHEN abs(m - floor(m + 0.5)) < 1e-9 THEN floor(m + 0.5) ELSE m END AS m) FROM m0),
q AS (SELECT *, CAST(floor(m) AS BIGINT) sure, m - floor(m) p, sum(size * CAST(floor(m) AS BIGINT)) OVER (PARTITION BY source) sure_words FROM m),
r AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END q FROM q),
x AS (SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (PARTITION BY source, p > 0 ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) END upto, target - sure_words AS rest FROM r)
SELECT doc_id, size, source_size, target, size * (sure + CASE WHEN p > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END) taken FROM x"""

OP8 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS "first" FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> "first" THEN 'revisit' ELSE 'response' END record_type, CASE WHEN payload_bytes >= 100 AND page_id <> "first" THEN "first" END refers_to FROM f"""

#: The table of the checksum's 256 bytes, and the unsigned crc32 of a string's UTF-8 bytes.
_crc_table = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc(s: str) -> str:
    data = f"list_transform(range(strlen({s})), lambda i: CAST('0x' || substr(hex(encode({s})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = f"""WITH RECURSIVE k AS (SELECT {_crc_table} tab),
t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) w FROM documents),
c AS (SELECT w, id || ':' || w said, count(*) c FROM t WHERE length(w) >= {spelling.LEAST} GROUP BY id, w),
h AS (SELECT w, c, {_crc('said')} h FROM c, k),
v AS (SELECT CASE WHEN h % {spelling.TYPO} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END word, c FROM h),
x AS (SELECT word, CAST(sum(c) AS BIGINT) n FROM v WHERE length(word) >= {spelling.LEAST} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) i FROM x)),
p AS (SELECT a.word, b.word near, b.n m FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, x.word, x.n FROM d JOIN x ON d.v = x.word UNION SELECT x.word, d.word, d.n FROM d JOIN x ON d.v = x.word),
g AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1),
f AS (SELECT x.word, n, coalesce(n_near, 0) n_near, CASE WHEN m >= {spelling.TIMES} * n THEN near END form, CASE WHEN m >= {spelling.TIMES} * n THEN m END form_n FROM x LEFT JOIN g ON x.word = g.word),
r(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) root, f.n, f.n_near, f.form_n FROM f LEFT JOIN (SELECT r.word, r.root FROM r JOIN f ON r.root = f.word AND f.form IS NULL) e ON f.word = e.word"""


def _features(table: str, key: str) -> str:
    ws = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"SELECT id, {key}, len(ws) n_words, ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) fs FROM (SELECT row_number() OVER () id, {key}, {ws} ws FROM {table})"


OP13 = f"""WITH k AS (SELECT {_crc_table} tab),
dw AS ({_features('documents', 'doc_id')}), bw AS ({_features('benchmark', 'item_id')}),
df AS (SELECT id, f, count(*) c FROM (SELECT id, unnest(fs) f FROM dw) GROUP BY id, f), bf AS (SELECT f, count(*) c FROM (SELECT unnest(fs) f FROM bw) GROUP BY f),
h AS (SELECT f, {_crc('f')} % {resampling.BUCKETS} b FROM (SELECT f FROM df UNION SELECT f FROM bf), k),
s AS (SELECT b, CAST(sum(c) AS DOUBLE) s FROM df JOIN h USING (f) GROUP BY b), t AS (SELECT b, CAST(sum(c) AS DOUBLE) t FROM bf JOIN h USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0.0::DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0.0::DOUBLE) FROM s) + {resampling.BUCKETS}) / ((coalesce(s, 0.0::DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0.0::DOUBLE) FROM t) + {resampling.BUCKETS})))) AS BIGINT) gain FROM (SELECT range b FROM range({resampling.BUCKETS})) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT id, CAST(sum(c) AS BIGINT) n_features, CAST(floor(CAST(sum(c * gain) AS DOUBLE) / CAST(sum(c) AS DOUBLE)) AS BIGINT) weight FROM df JOIN h USING (f) JOIN g USING (b) GROUP BY id),
x AS (SELECT doc_id, n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, CAST('0x' || left(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) h FROM dw LEFT JOIN w USING (id)),
y AS (SELECT *, n_words >= {resampling.MIN_WORDS} fit, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) r, {resampling.PERCENT} * count(*) FILTER (fit) OVER () // 100 drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= drawn THEN r END "rank" FROM z"""

ORACLES: dict[str, str] = {"op3_chat_events": OP3, "op4_adaptive_quality": OP4, "op8_arc_to_warc": OP8, "op9_hamming_neardup": OP9, "op10_pareto_mix": OP10, "op11_spelling_variants": OP11, "op13_importance_resampling": OP13}
