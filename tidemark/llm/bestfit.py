"""Best-fit packing of token ids into sequences, planned over the histogram of lengths.

Each task turns its texts into ids, cuts those of more than CAPACITY into pieces, and numbers the pieces of each length among its own.
The driver gets the histogram of lengths (CAPACITY rows at most) and places counts, not pieces: from the longest length down, all pieces
of a length go where the least room that holds them is left (best fit decreasing), whole groups of equally filled sequences at a time.
The plan is a list of runs: pieces of this length from this rank on take this many places in each of these sequences, from this offset on.
A run empties a group of sequences or ends a length, so there are a few runs a length, a bound that doesn't grow with the corpus.
Pieces then take their places by joining the plan on their length and rank: the task's count of earlier
pieces of that length plus the number in the task. No pieces meet in a group, so a length that a third of all pieces
have is no hot key.

The tokenizer lower-cases and works on its own words (letters, a digit, signs, endings after an apostrophe), so ids are made once a word,
kept in a worker's bounded table, and joined: all texts of a batch are cut into words at once, by the classes of their Latin-1 bytes, and
Arrow numbers the different words. Runs between white space that hold other characters, or a special token, go through the whole
tokenizer, once a run, and stand as one sign meanwhile.

Defined cases: a null or empty text is the end id alone; texts are tokenised whole, however long; repeated rows and null ids are packed like
any other rows; a text of exactly CAPACITY ids isn't cut; extra columns are left out; empty tables give empty tables.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import pairwise
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, hint_if_small, small_batches

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Words and runs whose ids a worker holds (twice so many of each for a while), the longest of them, and characters looked at in one go.
HELD_RUNS, LONG_RUN, PART = 400_000, 60, 1 << 22
#: White space at which a text can be cut; what is left to the tokenizer between such.
_SPACE = re.compile("[ \t\n\r]")
#: Classes of the Latin-1 characters in the tokenizer's pattern, and those characters in lower case.
BLANK, LETTER, NUMBER, SIGN, RUN = range(5)
_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")


def _class(c: str) -> int:
    if c == "\0":
        return RUN
    if c in "\t\n\v\f\r \x85\xa0":
        return BLANK
    return {"L": LETTER, "N": NUMBER}.get(category(c)[0], SIGN)


_CLASS = bytes(_class(chr(b)) for b in range(256))
#: How a byte-level vocabulary shows bytes: as themselves if printable, else by the next sign from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART and (m := _SPACE.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Held:
    """Values of byte strings, made once and kept in a bounded table; the long ones are not kept."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]]):
        self.make, self.held, self.older = make, {}, {}

    def of(self, keys: list[bytes]) -> list[bytes]:
        """The values of different keys."""
        if len(self.held) > HELD_RUNS:
            self.older, self.held = self.held, {}
        out = list(map(self.held.get, keys))
        if missing := [i for i, x in enumerate(out) if x is None]:
            for i in missing:
                if (x := self.older.get(keys[i])) is not None:
                    out[i] = self.held[keys[i]] = x
            missing = [i for i in missing if out[i] is None]
            for i, x in zip(missing, self.make([keys[i] for i in missing]), strict=True):
                out[i] = x
                if len(keys[i]) <= LONG_RUN:
                    self.held[keys[i]] = x
        return out


def _latin(text: str) -> bytes | None:
    """text in Latin-1, if it has neither other characters, the sign of a run, nor a special token's beginning."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b"\0" in data or b"<|" in data else data


def _word_starts(low: bytes) -> np.ndarray:
    """For each byte of lower-case Latin-1 text, whether one of the tokenizer's words starts there: runs of letters, single numbers, runs of signs, and, where no sign stands before, apostrophes with an ending."""
    x, kinds = np.frombuffer(low, np.uint8), np.frombuffer(low.translate(_CLASS), np.uint8)
    starts = np.ones(len(x), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts |= (kinds == NUMBER) | (kinds == RUN)
    starts &= kinds != BLANK
    at = np.flatnonzero(x == ord("'"))
    at = at[starts[at]]
    one, two = (np.where(at + k < len(x), x[np.minimum(at + k, len(x) - 1)], 0) for k in (1, 2))
    short = np.isin(one, list(b"stmd"))
    long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    starts[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    after = after[after < len(x)]
    starts[after[kinds[after] != BLANK]] = True
    return starts


class Ids:
    """Token ids of texts, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.runs = Held(self._of_words), Held(self._of_runs)

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of the tokenizer's words, in Latin-1, by its merges alone."""
        merges, out = self.model.tokenize, []
        for w in words:
            text = w.decode("latin-1")
            if not (w.isascii() and text.isprintable()):
                text = text.encode().decode("latin-1").translate(_SHOWN)
            out.append(array("I", [t.id for t in merges(text)]).tobytes())
        return out

    def _of_runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs, in UTF-8, by the whole tokenizer."""
        out = []
        for i in range(0, len(runs), 10_000):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([r.decode() for r in runs[i : i + 10_000]], add_special_tokens=False)]
        return out

    def _parts_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts."""
        other: list[bytes] = []
        plain = []
        for p in parts:
            if (data := _latin(p)) is None:
                runs = [_latin(r) or r for r in _SPACE.split(p)]
                other += [r.encode() for r in runs if r and isinstance(r, str)]
                data = b" ".join([r if isinstance(r, bytes) else b"\0"[: len(r)] for r in runs])
            plain.append(data)
        ends = np.cumsum([len(p) + 1 for p in plain])
        low = b"\n".join(plain).translate(_LOWER)
        starts = _word_starts(low)
        x = np.frombuffer(low, np.uint8)
        at = np.flatnonzero(starts)
        kept = np.frombuffer(low.translate(_CLASS), np.uint8) != BLANK
        x, offsets = x[kept], np.append(np.flatnonzero(starts[kept]), np.count_nonzero(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(x)]).dictionary_encode()
        nth = words.indices.to_numpy(zero_copy_only=False).copy()
        ids = self.words.of(words.dictionary.to_pylist())
        if other:
            places = {r: len(ids) + i for i, r in enumerate(dict.fromkeys(other))}
            ids += self.runs.of(list(places))
            nth[x[offsets[:-1]] == 0] = [places[r] for r in other]
        joined = pa.array(ids, pa.binary()).take(pa.array(nth))
        cuts = np.frombuffer(joined.buffers()[1], np.int32, len(at) + 1) if len(at) else np.zeros(1, np.int32)
        data = memoryview(joined.buffers()[2] or b"") if len(at) else memoryview(b"")
        cuts = cuts[np.searchsorted(at, np.concatenate([[0], ends]))].tolist()
        return [bytes(data[a:b]) for a, b in pairwise(cuts)]

    def of(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = []
        waiting: list[tuple[list[bytes], str]] = []
        size = 0

        def join() -> None:
            for (joined, _), ids in zip(waiting, self._parts_ids([part for _, part in waiting]), strict=True):
                joined.append(ids)
            waiting.clear()

        for text in texts:
            out.append([])
            for part in _parts(text):
                waiting.append((out[-1], part))
                size += len(part)
                if size > PART:
                    join()
                    size = 0
        if waiting:
            join()
        return [b"".join(x) for x in out]


_models: dict[str, Ids] = {}


def _model(path: str) -> Ids:
    """One for each worker process, whatever the number of its tasks."""
    if path not in _models:
        _models[path] = Ids(path)
    return _models[path]


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, ids: bool = False) -> DataFrame:
    """task, doc_id, piece, start, length, ids_crc32, rank (among the task's pieces of that length) and, if asked for, the piece's ids."""
    kinds = [("task", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("rank", pa.int64())] + [("ids", pa.binary())] * ids
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, model, seen = TaskContext.get().partitionId(), _model(vocabulary), np.zeros(capacity + 1, np.int64)
        for b in small_batches(batches, 1):
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), model.of([t or "" for t in b.column(1).to_pylist()]), strict=True):
                data += last
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((task, doc_id, k, at // 4, n, crc32(own), int(seen[n]), *([own] * ids)))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    sql = {"int32": "int", "int64": "long", "binary": "binary"}
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{k} {sql[str(t)]}" for k, t in kinds))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) of best fit decreasing over counts of lengths."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
    order: list[int] = []  # the rooms there are, ascending
    sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(order, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rest, rank = counts[length], 0
        while rest:
            i = bisect_left(order, length)
            if i < len(order):
                left = order[i]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], order[i]
            else:  # as many new ones as are needed
                left, first, n = capacity, sequences, -(-rest // (capacity // length))
                sequences += n
            per = left // length
            full = min(n, rest // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - left))
                put(left - per * length, first, full)
                rest, rank, first, n = rest - full * per, rank + full * per, first + full, n - full
            if n and 0 < rest < per:
                runs.append((length, rank, rest, first, rest, capacity - left))
                put(left - rest * length, first, 1)
                rest, first, n = 0, first + 1, n - 1
            put(left, first, n)
    return runs


def pack_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, with its ids (little-endian 32-bit) if asked for."""
    scratch = Scratch(spark, "bestfit")
    rows = scratch.table(token_pieces(docs, vocabulary, id_col, text_col, capacity, end_id, ids), "pieces")
    by_task = scratch.table(rows.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), "length long, first_rank long, n long, sequence long, per long, place long")
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(hint_if_small(before.select("task", "length", "before")), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    runs = hint_if_small(runs.withColumnRenamed("length", "of"))
    rows = rows.join(runs, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    nth = F.col("rank") - F.col("first_rank")
    out = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    return rows.select(*out, (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"), (F.col("place") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"), *(["ids"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit, gapless) and doc_ids of each sequence, from pieces with their ids."""
    one = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most one piece a token of the capacity
    joined = F.aggregate("p", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"]))
    return packed.groupBy("sequence_id").agg(one.alias("p")).select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
