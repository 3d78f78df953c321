"""The whole pipeline against its stages by SQL and brute force, on a small corpus with junk, copies, secrets and long texts."""

import collections
import itertools
import random
import re

import duckdb
import pytest

import corpus_pipeline
from test_operators import brute_components
from tidemark.llm import oracles, secrets


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice(("ba", "lo", "mi", "ren", "tus", "vel", "dor", "phi")) for _ in range(rng.randint(2, 4))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = []
    for i in range(150):
        t = text(rng.randint(25, 120))
        if i % 10 == 1:
            t = re.sub(" ", " *** ", t)
        elif i % 10 == 2:
            t = text(5)
        elif i % 10 == 3:
            t += " password=" + "".join(rng.choice("abcdefghjkmnpqrstuvwxyz23456789") for _ in range(14)) + " the token is xK9!qZ7#pL2w."
        elif i % 10 in (4, 5) and i > 20:
            t = out[i - 20][1] or t
            if i % 10 == 5 and t:
                t = t.replace(t.split()[0], "edited", 1) + " end"
        out.append((i, t, ("en", "de", None)[i % 3], (None, "a", "b", "a")[i % 4]))
    out += [(150, None, "en", "a"), (151, "", "en", "a"), (152, text(9000), "en", "b")]
    return [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def by_sql(spark, docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    result = con.sql(sql)
    names = [d[0] for d in result.description]
    return [dict(zip(names, r, strict=True)) for r in result.fetchall()]


def brute_known(texts):
    """The known words by counting texts one by one."""
    words = lambda x: [w for w in re.split(r"[\W\d_]+", x) if 3 <= len(w) <= 24]
    n, inside, seen = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text in texts:
        low = (text or "").lower()
        for m in secrets.CONTEXT.finditer(low):
            inside.update(words(m[1]))
        rest = secrets.CONTEXT.sub(" ", low)
        n.update(words(rest))
        for w in words(rest):
            seen[w].add(rest)
    found = [w for w in n if len(seen[w]) >= secrets.MIN_TEXTS and n[w] >= 2 * inside[w]]
    return secrets.Known((w, n[w] >= secrets.SETTLED) for w in sorted(found, key=lambda w: (-n[w], w)))


def test_pipeline_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    quality, neardup, secret, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    counts = lambda df: collections.Counter(r.doc_id for r in df.collect())

    kept = quality(spark, docs, folder).cache()
    assert counts(kept) == collections.Counter(r["doc_id"] for r in by_sql(spark, docs, oracles.OP4) if r["kept"])
    assert not any(i % 10 in (1, 2) for i in counts(kept) if i < 150)  # junk and short texts

    left = neardup(spark, kept, folder).cache()
    _, label = brute_components({r.doc_id: r.text or "" for r in kept.collect()}, 5)
    assert counts(left) == collections.Counter(k for k, v in label.items() if k == v) and left.count() < kept.count()

    clean = secret(spark, left, folder).cache()
    known = brute_known([r.text for r in left.collect()])
    want = {r.doc_id: secrets.redacted(r.text, known) for r in left.collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert sum("[assign secret]" in t for t, _ in got.values()) > 3 and not any("xK9!" in t for t, _ in got.values())

    mixed = mixing(spark, clean, folder).cache()
    taken = collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in by_sql(spark, clean, oracles.OP10) if r["taken"]})
    assert counts(mixed) == taken

    packed = packing(spark, mixed, folder).collect()
    lengths = {r.doc_id: len(r.text.encode().split()) for r in mixed.collect()}
    assert collections.Counter(r.doc_id for r in packed) == taken and all(r.n_tokens == lengths[r.doc_id] for r in packed)
    batches = collections.defaultdict(list)
    for r in packed:
        batches[r.bucket, r.batch].append(r)
    per = {b: max(1, 16_384 // r[0].bound) for b, r in batches.items()}
    assert all(len(rows) <= per[b] and sorted(r.slot for r in rows) == list(range(len(rows))) for b, rows in batches.items())
    last = {k: max(b for a, b in batches if a == k) for k, _ in batches}
    assert all(len(rows) == per[b] for b, rows in batches.items() if b[1] < last[b[0]])

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.bucket, r.bound) for r in whole) == sorted((r.doc_id, r.n_tokens, r.bucket, r.bound) for r in packed)


def test_bounds_are_optimal_over_many_lengths():
    from tidemark.llm.packing import optimal_bounds

    rng = random.Random(9)
    lengths = sorted(rng.sample(range(1, 2_000_000), 60))
    counts = [rng.randint(1, 50) for _ in lengths]
    best = {0: {-1: 0}}  # buckets used: last length covered: cost
    upto = list(itertools.accumulate(counts, initial=0))
    for k in range(1, 7):
        best[k] = {i: min(best[k - 1][j] + lengths[i] * (upto[i + 1] - upto[j + 1]) for j in best[k - 1] if j < i) for i in range(len(lengths)) if any(j < i for j in best[k - 1])}
    got = optimal_bounds(lengths, counts, 6)
    cost = sum(c * next(b for b in got if b >= n) for n, c in zip(lengths, counts, strict=True))
    assert len(got) <= 6 and cost == min(v[len(lengths) - 1] for k, v in best.items() if k and len(lengths) - 1 in v)
