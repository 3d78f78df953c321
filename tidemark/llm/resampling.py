"""Target-distribution importance resampling over hashed word runs, in two Arrow passes.

Features are all runs of 1 to LONGEST consecutive words, each hashed into one of BUCKETS buckets. In the first pass
every task of either table counts its features with np.bincount into one vector of BUCKETS numbers; treeReduce adds the
vectors, so the driver gets two of them, whatever the corpus's size. From both come the buckets' gains, which are broadcast (80 KB).
In the second pass each text's gains are gathered and summed by np.bincount with weights, one sum a row; the floored mean
is the text's weight. Gumbel noise from a digest of the id makes a weighted draw without replacement of the highest scores.

Scores are ranked without gathering them: rows are dealt to ranges of score and id, sorted in each, and a range's rows
are numbered on from the counts of the ranges before it.

Words lower-case A-Z only and are runs of anything but ASCII signs, controls and spaces. Texts are read whole, in pieces of
bounded size.

Defined cases: null and empty texts have no features, weight 0 and are never drawn; a null id is drawn by the digest of an
empty id and comes last among ties; repeated rows are counted, scored and ranked each; ties fall to the smaller id, then to fewer features; an empty target
gives every bucket its gain against nothing; extra columns are left out by ``resample`` and stay, whatever their names, in ``draw``, where rows that
equal the last drawn one in score and id are drawn with it; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, hint_if_small, packed, pieces, small_batches

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Features gathered before they are counted.
HELD = 1 << 20
#: Bytes of words: digits, letters (A-Z to lower case) and all of other characters; the rest to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) of each piece of a text."""
    before: list[bytes] = []  # the last words of the piece before
    for piece in pieces(text.translate(_TABLE)):
        new = piece.split()
        words = before + new
        runs, found = list(map(crc32, words)), []
        for k in range(1, longest + 1):
            if k > 1:  # a run's checksum goes on from that of the run without its last word
                runs = list(map(crc32, words[k - 1 :], map(crc32, repeat(b" "), runs)))
            found.append(np.array(runs[max(0, len(before) - k + 1) :], np.uint32) % np.uint32(buckets))
        yield len(new), np.concatenate(found).astype(np.int64)
        before = words[len(words) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in small_batches(batches, 0):
            held, n = [], 0
            for text in b.column(0).cast(pa.binary()):
                for _, found in features(text.as_py() or b"", longest, buckets):
                    held.append(found)
                    n += len(found)
                    if n > HELD:
                        total += np.bincount(np.concatenate(held), minlength=buckets)
                        held, n = [], 0
            if n:
                total += np.bincount(np.concatenate(held), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    vectors = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "v binary").rdd.map(lambda r: np.frombuffer(bytes(r.v), np.int64))
    return vectors.treeReduce(lambda a, b: a + b, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) / (T + buckets) * (S + buckets) / (s + 1))) of each bucket."""
    n, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 * Gumbel noise) from the id's digest."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(gains: np.ndarray, texts: pa.Array, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and weight of each text."""
    n = len(texts)
    words, counts, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    rows: list[int] = []
    held: list[np.ndarray] = []

    def add() -> None:
        nonlocal sums
        if held:
            sums += np.bincount(np.repeat(rows, list(map(len, held))), gains[np.concatenate(held)], n)
            rows.clear(), held.clear()

    gathered = 0
    for i, text in enumerate(texts.cast(pa.binary())):
        for n_words, found in features(text.as_py() or b"", longest, len(gains)):
            words[i] += n_words
            counts[i] += len(found)
            rows.append(i)
            held.append(found)
            gathered += len(found)
            if gathered > HELD:
                add()
                gathered = 0
    add()
    return words, counts, sums.astype(np.int64) // np.maximum(counts, 1)


def gains_of(spark: SparkSession, docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> Broadcast:
    """The gains for drawing docs like target, broadcast."""
    return spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets)))


def scores(docs: DataFrame, gains: Broadcast, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    names = ("doc_id", "n_words", "n_features", "weight", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            words, counts, weights = weighed(gains.value, b.column(1), longest)
            lots = np.array([noise(x, seed) for x in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, counts, weights, weights + lots))], names=list(names))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("at")]


def ranked(spark: SparkSession, scored: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """The rows of min_words or more with place (1, 2, ... by score, then id). scored: a table, read twice."""
    scratch = scratch or Scratch(spark, "resampling")
    rows = scored.where(F.col("n_words") >= min_words).withColumn("at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.table(rows.withColumn("range", F.shiftright("at", 33)), "ranges")
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))  # a row for each partition
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    return rows.join(hint_if_small(sizes), "range").withColumn("place", F.col("before") + F.col("at") - F.shiftleft("range", 33) + 1)


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row."""
    scratch = Scratch(spark, "resampling")
    scored = scratch.table(scores(docs, gains_of(spark, docs, target, text_col, target_col), id_col, text_col), "scores")
    order = ranked(spark, scored, min_words, scratch)
    drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return order.select(*out, F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank")).unionByName(rest)


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of docs with all their columns: the score of the last drawn row is looked up, and texts are weighed again rather than shuffled."""
    scratch = Scratch(spark, "resampling")
    gains = gains_of(spark, docs, target, text_col, target_col)
    scored = scratch.table(scores(docs, gains, id_col, text_col), "scores")
    drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100
    last = ranked(spark, scored, min_words, scratch).where(F.col("place") == drawn).select("score", "doc_id").head()
    if last is None:
        return docs.limit(0)

    def judge(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ids, texts in columns:
            words, _, weights = weighed(gains.value, texts)
            keep = []
            for x, n, w in zip(ids.to_pylist(), words.tolist(), weights.tolist(), strict=True):
                s = w + noise(x)
                keep.append(n >= min_words and (s > last.score or s == last.score and (last.doc_id is None or x is not None and x <= last.doc_id)))
            yield pa.array(keep, pa.bool_())

    chosen = F.arrow_udf(judge, "boolean")
    return docs.select(packed(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(chosen("id", "text")).select("row.*")
