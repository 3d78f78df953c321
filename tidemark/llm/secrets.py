"""Secret scans: fixed patterns, and password guess costs of values in a credential context.

Base patterns give spans of kinds ``assign``, ``access`` and ``hex``. Besides, every value that stands after a
credential word, inside a base span or not, is priced by dynamic programming: the cheapest segmentation into known words (with
capitals and look-alike signs), single signs between words, dates, repeats, runs of the alphabet, keyboard walks and brute-force
stretches, each costing the decimal logarithm of the guesses it takes, plus SEAM for every further segment.
A value of MIN_GUESSES or more becomes a span of kind ``guess`` beside the base ones, and so does a value that base spans cover
in part only, whatever it costs.

Known words are those that the corpus itself uses (``vocabulary``): words of letters that stand outside credential contexts in
MIN_TEXTS or more different texts (exact copies are one), and there at least twice as often as inside such contexts; the WORDS commonest at most. A leaked value that some texts
repeat is so no known word. A word costs its rank; one of SETTLED uses or more costs no
more than DEAREST, since a word of running text is no secret. So prose is cheap in any language the corpus
holds. Some common password words (COMMON) rank first.

The programme's steps grow with the length of a value, not its square: words are looked up to the longest
word's length, and repeats, runs and walks are maximal. Spans are code points, end exclusive.

Defined cases: null and empty texts have no spans; texts are scanned whole, however long; equal rows get
equal results; extra columns stay in ``redact``, whatever their names, and are left out by ``find_secrets``; empty tables give
empty tables.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, packed, small_batches
from tidemark.llm.lm import known_from

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|secret|signing)[_-]?key)["']?(?:\x20*[:=]\x20*|\x20+(?:is|was)\x20+|\x20+)["']?([^\s"'<>]{8,})""", re.A | re.I)
HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "key")
#: Least log10 guesses of a flagged value, log10 guesses for each further segment, and those of a known word at most.
MIN_GUESSES, SEAM, DEAREST = 10.0, 0.3, 4.3
#: Known words of the corpus at most, the different texts that one needs to be known, and the uses it needs to be cheap whatever its rank.
WORDS, MIN_TEXTS, SETTLED = 200_000, 5, 20
#: Distinct words a task holds before it passes them on; the largest number that holds MIN_TEXTS - 1 digests of 16 bits.
HELD_WORDS, FOUR = 300_000, (1 << 16 * (MIN_TEXTS - 1)) - 1
#: Signs that join words, one of which is a cheap segment.
JOINERS = "-_./'"

# Common password words, most common first.
COMMON = (
    "password qwerty admin welcome letmein monkey dragon login abc iloveyou master hello freedom whatever trustno shadow sunshine princess football baseball superman batman"
    " secret test guest root user changeme default pass temp demo example sample access token key system server database oracle mysql postgres public private"
    " summer winter spring autumn monday friday january february march april june july august october november december"
    " love money happy star flower cheese computer internet google company business office home house apple orange banana chicken coffee cookie pepper ginger"
    " michael jennifer jordan michelle daniel jessica charlie andrew thomas robert george joshua matthew ashley amanda nicole hunter ranger soccer hockey tiger"
    " killer silver golden purple yellow black white green blue red the and for you not with this that from have your are was"
    " required missing invalid expired string value empty none null true false optional placeholder redacted hidden"
).split()


class Known(dict):
    """log10 guesses of each known word: COMMON ones, then others (the commonest first), each with its rank; those that are settled cost DEAREST at most."""

    def __init__(self, words: Iterable[tuple[str, bool]] = ()):
        settled = dict.fromkeys(COMMON, True)
        for word, is_settled in words:
            settled.setdefault(word, is_settled)
        costs = ((w, math.log10(i + 2), cheap) for i, (w, cheap) in enumerate(settled.items()))
        super().__init__({w: min(c, DEAREST) if cheap else c for w, c, cheap in costs})
        self.longest = max(map(len, self))


PLAIN = Known()
# Look-alike signs, and the rows of a keyboard.
LEET = str.maketrans("@4310$57!", "aaeiosstl")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {(a, b) for y, row in enumerate(ROWS) for x, a in enumerate(row) for dy in (-1, 0, 1) if 0 <= y + dy < len(ROWS) for dx in ((-1, 1) if not dy else (0, 1) if dy < 0 else (-1, 0)) if 0 <= x + dx < len(ROWS[y + dy]) for b in (ROWS[y + dy][x + dx],)}
DATES = (re.compile(r"(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})"), re.compile(r"(\d{1,2})([-/.]?)(\d{1,2})\2(\d{4}|\d{2})"))
YEAR = re.compile(r"19\d\d|20[0-4]\d")


def _class(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def _maximal(n: int, linked, least: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches in which every position but the first is linked to the one before."""
    start = 0
    for i in range(1, n + 1):
        if i == n or not linked(i):
            if i - start >= least:
                yield start, i
            start = i


def matches(value: str, known: Known = PLAIN) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every cheap pattern in a value."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    for i in range(n):
        if value[i] in JOINERS:
            yield i, i + 1, math.log10(len(JOINERS))
        for j in range(i + 3, min(n, i + known.longest) + 1):
            cost = known.get(low[i:j])
            signs = 0.0
            if cost is None and (cost := known.get(plain[i:j])) is not None:
                signs = math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
            if cost is not None:
                word = value[i:j]
                capitals = 0.0 if word == low[i:j] else math.log10(2) if word[1:] == low[i + 1 : j] or word.isupper() else math.log10(2) * sum(a != b for a, b in zip(word, low[i:j], strict=True))
                yield i, j, cost + signs + capitals
        if m := YEAR.match(value, i):
            yield i, m.end(), math.log10(150)
        for pattern, order in zip(DATES, ((1, 3, 4), (4, 3, 1)), strict=True):
            if m := pattern.match(value, i):
                y, a, b = (int(m[k]) for k in order)
                for month, day in ((a, b), (b, a)):
                    try:
                        datetime.date(y if y > 99 else 2000 + y, month, day)
                    except ValueError:
                        continue
                    if y < 100 or 1900 <= y <= 2050:
                        yield i, m.end(), math.log10(365 * 150 * (4 if m[2] else 1))
                        break
    for p in range(1, 7):
        for a, b in _maximal(n - p + 1, lambda i, p=p: value[i - 1] == value[i + p - 1], p + 1 if p > 1 else 3):
            end = b + p - 1
            if end - a >= max(3, 2 * p):
                yield a, end, sum(math.log10(_class(c)) for c in value[a : a + p]) + math.log10((end - a) / p)
    for step in (1, -1):
        for a, b in _maximal(n, lambda i, step=step: ord(value[i]) - ord(value[i - 1]) == step and _class(value[i]) == _class(value[i - 1]) < 33, 3):
            yield a, b, math.log10(_class(value[a]) * (b - a) * (1 if step > 0 else 2))
    for a, b in _maximal(n, lambda i: (low[i - 1], low[i]) in NEAR, 4):
        steps = [(low[i - 1], low[i]) for i in range(a + 1, b)]
        rows = [next(y for y, r in enumerate(ROWS) if x in r) for s in steps for x in s]
        turns = 1 + sum(rows[2 * i + 1] - rows[2 * i] != rows[2 * i + 3] - rows[2 * i + 2] for i in range(len(steps) - 1))
        yield a, b, math.log10(len(NEAR) * (b - a)) + turns * math.log10(6)


def guess_cost(value: str, known: Known = PLAIN) -> float:
    """The least log10 guesses over all segmentations of a value."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in matches(value, known):
        ending.setdefault(j, []).append((i, cost))
    best, brute = [-SEAM] + [math.inf] * n, math.inf  # brute: the best in which a brute-force stretch is open
    for j in range(1, n + 1):
        brute = min(best[j - 1] + SEAM, brute) + math.log10(_class(value[j - 1]))
        best[j] = min([brute, *(best[i] + SEAM + cost for i, cost in ending.get(j, ()))])
    return best[n] if n else 0.0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    low, out = text.lower(), []
    if any(w in low for w in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def all_spans(text: str, base: list[tuple[int, str, int]] | None = None, known: Known = PLAIN) -> list[tuple[int, str, int]]:
    """Base spans and those of costly values."""
    out = base_spans(text) if base is None else list(base)
    low = text.lower()
    if any(w in low for w in HINTS):
        held = sorted((s, e) for s, _, e in out)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)")
            a, b = m.start(1), m.start(1) + len(value)
            if len(value) < 8:
                continue
            upto, touched = a, False  # upto: how far base spans cover the value from its start on
            for s, e in held:
                touched |= s < b and a < e
                if s <= upto:
                    upto = max(upto, e)
            # a base span that takes part of a value has found a secret: the rest belongs to it
            if guess_cost(value, known) >= MIN_GUESSES or touched and upto < b:
                out.append((a, "guess", b))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _said(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _with(held: int, digests: int) -> int:
    """The 16-bit digests of both numbers in one, until there are MIN_TEXTS."""
    while digests and held <= FOUR:
        x, digest = held, digests & 0xFFFF
        while x and x & 0xFFFF != digest:
            x >>= 16
        if not x:
            held = held << 16 | digest
        digests >>= 16
    return held


def word_uses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (3 to 24 letters), n and n_inside (uses outside and inside credential contexts), n_texts (different texts with the word outside, up to MIN_TEXTS)."""

    def parts(w: str) -> list[str]:
        return [p for p in re.split(r"[\W\d_]+", w) if 3 <= len(p) <= 24]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        inside: Counter[str] = Counter()
        texts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            words: dict[str, list[int]] = {}
            for w, c in n.items():
                for p in parts(w):
                    held = words.setdefault(p, [0, 0, 0])
                    held[0] += c
                    held[2] = _with(held[2], texts[w])
            for w, c in inside.items():
                for p in parts(w):
                    words.setdefault(p, [0, 0, 0])[1] += c
            n.clear(), inside.clear(), texts.clear()
            full = [x > FOUR for *_, x in words.values()]
            digests = np.array([0 if f else x for f, (*_, x) in zip(full, words.values(), strict=True)], np.uint64).view(np.int64)
            counts = [pa.array([x[k] for x in words.values()], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), *counts, pa.array(full, pa.bool_()), pa.array(digests)], names=["word", "n", "n_inside", "full", "digests"])

        for b in small_batches(batches, 0):
            for text in b.column(0).to_pylist():
                low = (text or "").lower()
                if any(w in low for w in HINTS):
                    inside.update(x for m in CONTEXT.finditer(low) for x in m[1].split())
                    low = CONTEXT.sub(" ", low)
                own = Counter(low.split())
                n.update(own)
                digest = xxhash.xxh64_intdigest(low) % 0xFFFF + 1
                for w in own:
                    held = texts.get(w, 0)
                    if held <= FOUR:
                        texts[w] = _with(held, digest) if held else digest
                if len(n) > HELD_WORDS:
                    yield out()
        if n or inside:
            yield out()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long, n_inside long, full boolean, digests long")
    # a word that one task has met in MIN_TEXTS texts needs no digests; of others there are four a task at most
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"), F.max("full").alias("full"), F.collect_set(F.when(F.col("digests") != 0, F.col("digests"))).alias("digests"))
    each = F.flatten(F.transform("digests", lambda x: F.array(*(F.shiftrightunsigned(x, 16 * k).bitwiseAND(0xFFFF) for k in range(4)))))
    several = F.size(F.array_except(each, F.array(F.lit(0).cast("long"))))  # distinct ones
    return counts.select("word", "n", "n_inside", F.when(F.col("full"), MIN_TEXTS).otherwise(F.least(several, F.lit(MIN_TEXTS))).alias("n_texts"))


def vocabulary(spark: SparkSession, docs: DataFrame, text_col: str = "text", most: int = WORDS) -> list[tuple[str, bool]]:
    """The corpus's known words, commonest first, so many at most, each with whether it is settled."""
    known = word_uses(docs, text_col).where((F.col("n_texts") >= MIN_TEXTS) & (F.col("n") >= 2 * F.col("n_inside")))
    scratch = Scratch(spark, "secrets")
    counts = scratch.table(known.select("word", F.col("n").alias("c"), (F.col("n") >= SETTLED).alias("settled")), "words")
    top = counts.where(F.col("c") >= known_from(counts, most)).toArrow()  # at most so many rows
    scratch.drop(counts)
    rows = zip(*(top.column(k).to_pylist() for k in ("c", "word", "settled")), strict=True)
    return [(w, s) for _, w, s in sorted(rows, key=lambda x: (-x[0], x[1]))]


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, the base spans' digest and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    sent = spark.sparkContext.broadcast(vocabulary(spark, docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value)
        for b in small_batches(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                every = all_spans(text or "", base, known)
                n = {k: sum(s[1] == k for s in every) for k in KINDS}
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), n["guess"]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, known: Known = PLAIN) -> str:
    """The text with every span (overlapping ones as one) replaced by the sign of its first kind."""
    parts, at = [], 0
    for a, kind, b in all_spans(text, known=known):
        if a >= at:
            parts += [text[at:a], f"[{kind} secret]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the text redacted, and its length in code points put right if a column for it is named."""
    sent = spark.sparkContext.broadcast(vocabulary(spark, docs, text_col))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(sent.value)
        for x in texts:
            yield pa.array([None if t is None else redacted(t, known) for t in x.to_pylist()], pa.string())

    clean = F.arrow_udf(run, "string")
    # the row in one struct, so that no name of its own clashes
    rows = docs.select(packed(docs))
    text = F.col("row")[text_col]
    # most texts hold no hint of a secret and never leave the JVM
    suspect = F.lower(text).rlike("|".join(HINTS)) | text.contains("AKIA") | text.rlike("[0-9a-f]{16}")
    rows = rows.withColumn("new", F.coalesce(clean(F.when(suspect, text)), text))
    length = lambda c: F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c])
    return rows.select(*((F.col("new") if c == text_col else length(c) if c == length_col else F.col("row")[c]).alias(c) for c in docs.columns))
