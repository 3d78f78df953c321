"""Packing texts into batches of near-equal length: optimal length buckets, then token-budget batches.

Lengths are counted into a global histogram, exact at every length. Dynamic programming over it chooses at most ``buckets`` upper
bounds (each a length that occurs) so that padding every text to its bucket's bound costs the fewest tokens
in all; the cost obeys the quadrangle inequality, so each layer is solved by divide and conquer, all halves of one depth at once.
Inside a bucket a batch holds as many texts as the token budget allows at the bucket's bound (one at least).

The histogram has as many rows as there are distinct lengths, and d distinct lengths take d * d / 2 tokens: its size is
bounded by the root of twice the corpus's tokens, and by the longest text (6,000,000 rows of 16 bytes for 2e13 tokens).

Texts are ranked inside a bucket without sorting it in one task: rows are numbered as they are written, cells of about CELL rows by
that number are counted, each row's rank is its cell's offset plus its rank in the cell, and the batch number follows.
So all batches of a bucket but the last are full, and equal or null ids don't meet in one cell.

Defined cases: null and empty texts have length 0 and are packed (a batch of the least bound); a text longer
than the budget is a batch of its own, never cut; ties and repeated rows get batches like any other rows;
null ids are packed like others; empty tables give empty tables; extra columns stay in ``pack``
if asked for by ``keep``, whatever their names, but for those of the result itself (an error).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, hint_if_small, n_words

BUCKETS, BUDGET, CELL = 16, 16_384, 8192
RESULT = ("doc_id", "n_tokens", "bucket", "bound", "batch", "slot", "padding")


def _layer(best: np.ndarray, top: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs with one bucket more, and the last length of the bucket before (-1: none): the best split of a length lies between those of its neighbours."""
    n = len(best)
    new, choice = best.copy(), np.full(n, -1)
    lo, hi, a, b = (np.array([x]) for x in (0, n - 1, 0, n - 1))
    while len(lo):
        i = (lo + hi) // 2
        last = np.minimum(b, i - 1)
        size = np.maximum(last - a + 1, 0)
        some = size > 0
        k = a.copy()
        if some.any():
            starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            j = np.arange(size.sum()) - np.repeat(starts - a[some], size[some])
            at = np.repeat(i[some], size[some])
            cost = best[j] + top[at] * (upto[at + 1] - upto[j + 1])
            least = np.minimum.reduceat(cost, starts)
            hit = np.flatnonzero(cost == np.repeat(least, size[some]))  # the first of equal ones
            first = hit[np.searchsorted(hit, starts)]
            k[some] = j[first]
            better = least < new[i[some]]
            new[i[some][better]], choice[i[some][better]] = least[better], k[some][better]
        left, right = lo < i, i < hi
        lo, hi, a, b = np.concatenate([lo[left], i[right] + 1]), np.concatenate([i[left] - 1, hi[right]]), np.concatenate([a[left], k[right]]), np.concatenate([k[left], b[right]])
    return new, choice


def optimal_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, of at most so many buckets that minimise sum(counts * bound of the bucket). lengths: ascending and distinct, the last is a bound."""
    n = len(lengths)
    if not n:
        return []
    top, upto = np.asarray(lengths, np.float64), np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    best = top * upto[1:]  # one bucket for the first i + 1 lengths
    choices: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        new, choice = _layer(best, top, upto)
        if new[-1] >= best[-1]:
            break
        choices.append(choice)
        best = new
    bounds, i = [int(lengths[-1])], n - 1
    for choice in reversed(choices):
        if choice[i] < 0:  # no better than with one bucket fewer
            continue
        i = int(choice[i])
        bounds.append(int(lengths[i]))
    return sorted(set(bounds))


def bounds_of(sized: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The optimal bounds for a column n_tokens; the driver gets the histogram."""
    rows = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = (rows.column(c).to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(lengths)
    return optimal_bounds(lengths[order], counts[order], buckets)


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, n_tokens (words, unless a length is given), bucket, bound, batch (in the bucket), slot (in the batch), padding."""
    if clash := set(keep) & set(RESULT):
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    scratch = Scratch(spark, "packing")
    row = F.struct(F.col(id_col).alias("doc_id"), *(F.col(f"`{c}`") for c in keep)).alias("row")
    sized = docs.select(row, (n_words(F.col(text_col)) if length is None else length.cast("long")).alias("n_tokens"), F.monotonically_increasing_id().alias("at"))
    sized = scratch.table(sized, "lengths")
    bounds = bounds_of(sized, buckets)
    if not bounds:
        return sized.selectExpr("row.*", "n_tokens", "0 bucket", "0L bound", "0L batch", "0 slot", "0L padding").limit(0)
    at = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        at = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(at)
    rows = sized.withColumn("bucket", at)
    # at most len(bounds) rows
    cells = {r["bucket"]: max(1, r["count"] // CELL) for r in rows.groupBy("bucket").count().collect()}
    n_cells = F.element_at(F.array(*(F.lit(cells.get(i, 1)) for i in range(len(bounds)))), F.col("bucket") + 1)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("at"), n_cells).cast("int"))
    offsets = rows.groupBy("bucket", "cell").count().withColumn("offset", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("n_tokens", "at")) - 1)
    rows = rows.join(hint_if_small(offsets.select("bucket", "cell", "offset"), rows=sum(cells.values())), ["bucket", "cell"])
    bound = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("long")
    rows = rows.withColumn("bound", bound).withColumn("per", F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))), F.lit(1))).withColumn("place", F.col("offset") + F.col("rank"))
    return rows.select("row.*", "n_tokens", "bucket", "bound", F.floor(F.col("place") / F.col("per")).cast("long").alias("batch"), (F.col("place") % F.col("per")).cast("int").alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"))
