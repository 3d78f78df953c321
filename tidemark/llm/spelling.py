"""Spelling variants: words one edit apart, by forward and backward minimal acyclic automata with word numbers.

Words are counted over all texts (summed in each task before they are shuffled). Two words of which one edit (one code point inserted, deleted or
replaced) makes the other share their first half or their last half exactly. So each word is dealt to groups by the length of the shorter
word of a pair and by the half that agrees: as the shorter and as the longer one, by its first half forward and by its last half backward.
Tasks read sorted groups and build, over some thousand words at a time, the minimal acyclic automaton of the words (forward) or of the
reversed words (backward), each state with the count of words below it, so that a walk numbers a word without storing it. Each shorter word
is matched exactly through its half, then completed with one replaced or inserted code point; numbers give the words met
and their counts. Pairs found both ways are one.

A group of more than HOT rows is dealt again, by more of its words: of the part that is still free either the first or the last
half agrees as well. That ends at one free code point, so no group grows with the corpus beyond the alphabet's square.

Defined cases: null texts have no words; a null id counts as the empty text in the digest; repeated rows count each; texts are
whole, however long; ties of counts fall to the first word in code-point order; extra columns are left out; empty tables give empty tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hint_if_small, pieces, small_batches

LEAST, MIN_COUNT, TIMES, TYPO = 7, 2, 10, 31
#: Distinct words a task holds before it passes them on; rows of a group at most before it is split; rows of an automaton before it is closed.
HELD_WORDS, HOT, BLOCK = 300_000, 4000, 20_000
#: Latin letters (A-Z to lower case) and the code points from U+00C0 to U+00FF, as single bytes; the rest to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(doc_id: int | None, text: str, least: int = LEAST, typo: int = TYPO) -> Iterator[list[bytes]]:
    """The words of a text of so many code points, each piece's in order, in Latin-1; where the digest of id and run says so, a code point is missing."""
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    plain = text.isascii()
    for piece in pieces(text.encode("latin-1", "replace").translate(_TABLE)):
        words = [w for w in piece.split() if len(w) >= least]
        digests = [crc32(w, start) for w in words] if plain else [crc32(w if w.isascii() else w.decode("latin-1").encode(), start) for w in words]
        short = False
        for i, h in enumerate(digests):
            if not h % typo:
                w = words[i]
                at = h % len(w)
                words[i] = w[:at] + w[at + 1 :]
                short |= len(w) == least
        yield [w for w in words if len(w) >= least] if short else words


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """word and n of the words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in small_batches(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in runs_of(doc_id, text or "", least, typo):
                    held.update(words)
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them, the sum of what its walk passes by."""

    def __init__(self, words: list[bytes]):
        self.final: list[bool] = []
        self.below: list[int] = []  # words from a state on
        self.arcs: list[dict[int, tuple[int, int]]] = []  # sign: next state, words that stand before
        self._known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # the states of the last word, not yet shared
        last = b""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            self._share(path, same, last)
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._share(path, 0, last)
        self.root = self._state(*path[0])
        del self._known

    def _share(self, path: list[list], depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, *arcs)
        if (state := self._known.get(key)) is None:
            state = self._known[key] = len(self.final)
            before, held = int(final), {}
            for sign, to in arcs:
                held[sign] = (to, before)
                before += self.below[to]
            self.final.append(final)
            self.below.append(before)
            self.arcs.append(held)
        return state

    def walk(self, state: int, number: int, word: bytes, at: int = 0) -> tuple[int, int]:
        """State and number after word[at:]; state -1 if there is none."""
        for c in word[at:]:
            step = self.arcs[state].get(c)
            if step is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def completed(self, word: bytes, exact: int) -> Iterator[int]:
        """Numbers of the words that have word's first `exact` signs and come from word by one sign replaced or inserted after them."""
        state, number = self.walk(self.root, 0, word[:exact])
        if state < 0:
            return
        final = self.final
        for i in range(exact, len(word)):
            c = word[i]
            for sign, (to, before) in self.arcs[state].items():
                if sign != c:  # to insert the same sign is to insert it behind
                    for at in (i + 1, i):
                        end, found = self.walk(to, number + before, word, at)
                        if end >= 0 and final[end]:
                            yield found
            step = self.arcs[state].get(c)
            if step is None:
                return
            state, number = step[0], number + step[1]
        for to, before in self.arcs[state].values():
            if final[to]:
                yield number + before


def _key() -> Column:
    free = lambda side, n: F.expr(f"{side}(spelled, {n})")
    return F.concat_ws(":", "way", "m", "i", "j", free("left", "i"), free("right", "j"))


def groups(words: DataFrame, least: int = LEAST) -> DataFrame:
    """way (f, b), m (the shorter word's length), spelled (reversed in b), n, i and j (signs that agree in front and at the end), key."""
    size = F.length("word")
    rows = []
    for way in "fb":
        for longer in (0, 1):
            m = size - longer
            half = F.floor(m / 2) if way == "f" else m - F.floor(m / 2)
            spelled = F.col("word") if way == "f" else F.reverse("word")
            rows.append(F.when(m >= least, F.struct(F.lit(way).alias("way"), m.alias("m"), spelled.alias("spelled"), F.col("n"), half.cast("int").alias("i"), F.lit(0).alias("j"))))
    return words.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*").withColumn("key", _key())


def split(rows: DataFrame) -> DataFrame:
    """Each row by the first and by the last half of its free part."""
    free = F.col("m") - F.col("i") - F.col("j")
    first = F.floor(free / 2).cast("int")
    parts = F.array(F.struct((F.col("i") + first).alias("i"), F.col("j")), F.struct(F.col("i"), (F.col("j") + free - first).alias("j")))
    return rows.select("way", "m", "spelled", "n", F.explode(parts).alias("p")).select("way", "m", "spelled", "n", "p.i", "p.j").withColumn("key", _key())


def dealt(spark: SparkSession, words: DataFrame, least: int = LEAST, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """The rows of groups(), those of groups of more than `hot` rows dealt again until none is left but of one free code point."""
    scratch = scratch or Scratch(spark, "spelling")
    rows, done = groups(words, least), []
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.col("m") - F.col("i") - F.col("j")).alias("free")).where((F.col("c") > hot) & (F.col("free") > 1))
        large = scratch.table(large.select("key"), "hot")
        n = large.count()
        if not n:
            break
        large = hint_if_small(large, n)
        done.append(rows.join(large, "key", "left_anti"))
        rows = split(rows.join(large, "key", "left_semi"))
    for x in done:
        rows = rows.unionByName(x)
    return rows


def matched(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (word, n, near, near_n) one edit apart, word the shorter or first one; a pair can come twice. rows: of dealt()."""

    def pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = {s: n for _, _, s, n, _ in held}
        words = sorted(counts)
        automaton = Automaton(words)
        found = []
        for way, m, s, n, i in held:
            if len(s) == m:
                for k in automaton.completed(s, i):
                    a, b = (s, words[k]) if way == "f" else (s[::-1], words[k][::-1])
                    if len(a) == len(b) and a > b:
                        continue  # found from the other one
                    found.append((a.decode("latin-1"), n, b.decode("latin-1"), counts[words[k]]))
        for at in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + 50_000], strict=True), (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for b in batches:
            for key, way, m, s, n, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and key != last and (len(held) >= block or way != held[-1][0]):
                    yield from pairs(held)
                    held = []
                held.append((way, m, s.encode("latin-1"), n, i))
                last = key
        if held:
            yield from pairs(held)

    rows = rows.select("key", "way", "m", "spelled", "n", "i").repartition("key").sortWithinPartitions("way", "key")
    return rows.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(spark: SparkSession, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root (the last of its forms) from word and form; a form is TIMES as frequent, so that chains are short and end."""
    rows = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = hint_if_small(rows.select(F.col("word").alias("__w"), F.col("root").alias("__r")))
        new = scratch.table(rows.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__w").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        rows = new.select("word", "root")


def variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_count: int = MIN_COUNT, times: int = TIMES, typo: int = TYPO, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    scratch = Scratch(spark, "spelling")
    words = scratch.table(word_counts(docs, id_col, text_col, least, min_count, typo), "words")
    pairs = matched(dealt(spark, words, least, hot, scratch)).distinct()
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("near"), F.col("near_n").alias("m")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("m")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    shown = -F.col("best.m") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(shown, F.col("best.near")).alias("form"), F.when(shown, -F.col("best.m")).alias("form_n"))
    rows = scratch.table(rows, "forms")
    ends = roots(spark, rows.where("form IS NOT NULL"), scratch)
    return rows.join(hint_if_small(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
