"""Spelling variants, best-fit packing and importance resampling: brute force, awkward rows, split groups."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bestfit, common, resampling, spelling

SCHEMA = "doc_id long, text string, n long, word string, rank long, task int, length long, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, 4, 5) for i, t in rows], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(5)
    stems = ["receive", "separate", "definitely", "éclairage", "straße", "government", "occurred", "wÿrdÀnd"]
    rows = [(i, " ".join(rng.choice(stems) if rng.random() < 0.9 else "".join(rng.sample(rng.choice(stems), 6)) + "x" for _ in range(200))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (None, "Receive Receive, RECEIVE ÀÉ×÷ separat sepatate"), (3, rows[3][1]), (3, rows[3][1]), (104, "seperate " * 40_000 + "recieve\x00日本 recieve"), (105, "a" * 300_000)]
    return rows


def test_pieces():
    data = b"ab cd " * 1000 + b"e" * 5000 + b" f"
    got = list(common.pieces(data, 100))
    assert b"".join(got) == data and b" ".join(got).split() == data.split() and len(got) > 50
    assert list(common.pieces(b"")) == [b""]


# --- spelling variants


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_variants(rows):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("hot", [spelling.HOT, 3])
def test_variants(spark, hot):
    rows = odd_rows()
    rng = random.Random(9)
    for k in range(60):  # chains of forms, and words that share long halves
        w = "abcabcab"[:7] + rng.choice("abc") * (k % 3)
        i = rng.randrange(len(w))
        rows.append((1000 + k, " ".join([w[:i] + rng.choice("abc") + w[i + 1 :]] * rng.choice([1, 2, 30, 400]))))
    want = brute_variants(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark, frame(spark, rows), hot=hot).collect()}
    assert got == want and any(w[0] and w[1] != w[0] for w in want.values())
    assert spelling.variants(spark, frame(spark, rows).limit(0)).count() == 0


def test_groups_shrink(spark):
    """A group over the limit is dealt again until it fits, and loses no pair."""
    rng = random.Random(2)
    words = sorted({"pre" + "".join(rng.choice("abcd") for _ in range(rng.choice([4, 5]))) for _ in range(400)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.dealt(spark, df, hot=20).cache()
    assert rows.groupBy("key").count().join(rows.groupBy("key").agg(F.min(F.col("m") - F.col("i") - F.col("j")).alias("free")), "key").where("count > 20 AND free > 1").count() == 0
    got = {tuple(sorted((r.word, r.near))) for r in spelling.matched(rows, block=50).collect()}
    assert got == {(u, v) for u in words for v in words if u < v and near(u, v)}


def test_automaton():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.choice([7, 8]))) for _ in range(300)})
    a = spelling.Automaton(words)
    for i, w in enumerate(words):
        assert a.walk(a.root, 0, w)[1] == i
        for exact in (0, 3, 7):
            got = [words[k] for k in a.completed(w, exact)]
            assert len(got) == len(set(got)) and set(got) == {v for v in words if len(v) >= len(w) and near(w, v) and v[:exact] == w[:exact]}
    assert len(a.final) < len({w[:k] for w in words for k in range(9)})  # shared endings


# --- best-fit packing


def vocabulary():
    return pytest.importorskip("public_tokenizers").path(bestfit.VOCABULARY)


def pack_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Straße,", "naïve", "x1.5", "don't", "日本語", "<|endoftext|>"]) for _ in range(rng.choice([0, 1, 5, 40, 300, 3000])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "a\x1cb \u0085c d"), (2, rows[2][1]), (2, rows[2][1]), (105, "the " * 20_000), (106, "z" * 30_000), (107, "the " * 4095), (108, "the " * 4096)]


@pytest.mark.parametrize("capacity", [4096, 50])
def test_pack_tokens(spark, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = pack_rows()
    got = bestfit.pack_tokens(spark, frame(spark, rows), vocabulary(), capacity=capacity, ids=True).collect()
    want = collections.Counter()
    total = 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[i, k, at, len(own) // 4, zlib.crc32(own), own] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) <= brute_best_fit([r.length for r in got], capacity) and len(by) <= 1.05 * total / capacity + 1


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.choice([7, 20, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        counts = collections.Counter(lengths)
        bins = collections.defaultdict(list)
        ranks = collections.Counter()
        for length, first, n, sequence, per, place in bestfit.plan(dict(counts), capacity):
            assert first == ranks[length]
            ranks[length] += n
            for k in range(n):
                bins[sequence + k // per].append((place + k % per * length, length))
        assert ranks == counts and len(bins) == brute_best_fit(lengths, capacity)
        for places in bins.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
    # the plan doesn't grow with the counts
    sizes = [len(bestfit.plan({n: k * (1 + n % 7) for n in range(1, 4097)})) for k in (1, 1000, 10**8)]
    assert max(sizes) < 4 * 4096


def test_sequences(spark):
    df = frame(spark, [(1, "the cat"), (2, ""), (3, "dog " * 60)])
    packed = bestfit.pack_tokens(spark, df, vocabulary(), capacity=32, ids=True)
    rows = packed.collect()
    for s in bestfit.sequences(packed).collect():
        own = sorted((r.offset, r.doc_id, bytes(r.ids)) for r in rows if r.sequence_id == s.sequence_id)
        assert bytes(s.ids) == b"".join(x[2] for x in own) and s.doc_ids == [x[1] for x in own]
    assert bestfit.pack_tokens(spark, df.limit(0), vocabulary()).count() == 0


def test_ids_are_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bestfit, "HELD_RUNS", 50)
    monkeypatch.setattr(bestfit, "PART", 40)
    tokenizer, ids = Tokenizer.from_file(vocabulary()), bestfit.Ids(vocabulary())
    rng = random.Random(3)
    signs = "ab Z'śeé  \t\n\r\x1c\x1f\x85ΣςiİK<|endoftext|>12½한가　-—"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 90))) + rng.choice(["", " <|endoftext|>", "q" * 80]) for _ in range(600)]
    for at in range(0, 600, 30):
        part = texts[at : at + 30]
        assert ids.of(part) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def test_ids_are_made_once_a_word_not_once_a_run():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(vocabulary()), bestfit.Ids(vocabulary())
    made = []
    for held in (ids.words, ids.runs):
        held.make = lambda keys, make=held.make: made.extend(keys) or make(keys)
    texts = [" ".join(a + w + b for w in ("the", "Thé", "THÉ", "ﬁn")) for a in ("", "(", '"', "¿") for b in ("", ".", ",", "'s", "12")]
    assert ids.of(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    latin = [w for w in made if b"\xef\xac\x81" not in w]
    assert len(made) == len(set(made)) and len(latin) <= 2 + 3 + 4 + 2  # words, signs before and after (one is both kinds), digits


def test_ids_of_all_latin_characters_in_pairs():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(vocabulary()), bestfit.Ids(vocabulary())
    signs = [chr(b) for b in range(256)]
    texts = ["".join(a + b for b in signs) for a in signs] + [a + x + "'" + y for a in signs for x in ("", "'s") for y in ("s", "re", "rx", "ll", "lx", "d1", "", "m'", "tz")]
    assert ids.of(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ids.of([]) == [] and ids.of(["", "\0", "x"]) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ("", "\0", "x")]


# --- importance resampling


def brute_features(text, n=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def test_resample(spark):
    rng = random.Random(6)
    words = [f"w{i}é" for i in range(40)] + ["Alpha", "BETA's", "日本", "x_y"]
    rows = [(i, " ".join(rng.choice(words[: 10 + i % 30]) for _ in range(rng.choice([3, 19, 20, 60])))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, rows[7][1] * 9), (None, rows[7][1] * 9), (7, rows[7][1]), (502, "beta " * 30_000)]
    goal = [(1, "w1é w2é w3é"), (2, None), (3, "Beta S beta s")]
    docs, target = frame(spark, rows), spark.createDataFrame(goal, "item_id long, text string")
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for _, x in table for f in brute_features(x)[1]) for table in (rows, goal))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for i, text in rows:
        ws, fs = brute_features(text)
        w = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    fit = sorted((r for r in want if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * 25 // 100]):
        r[4] = k + 1
    got = resampling.resample(spark, docs, target).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got))) == sorted(repr(tuple(r[:5])) for r in want)
    drawn = resampling.draw(spark, docs, target)
    assert drawn.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in drawn.collect()) == collections.Counter((r[0], rows[k][1]) for k, r in enumerate(want) if r[4])
    assert resampling.resample(spark, docs.limit(0), target).count() == 0 == resampling.draw(spark, docs.limit(0), target).count()
    assert resampling.resample(spark, docs, target.limit(0)).count() == len(rows)


def test_features_across_pieces(monkeypatch):
    text = " ".join(f"w{i % 13}" for i in range(500)).encode()
    whole = np.sort(np.concatenate([x for _, x in resampling.features(text, 3)]))
    monkeypatch.setattr(resampling, "pieces", lambda data: common.pieces(data, 40))
    cut = list(resampling.features(text, 3))
    assert len(cut) > 5 and sum(n for n, _ in cut) == 500 and np.array_equal(np.sort(np.concatenate([x for _, x in cut])), whole)
