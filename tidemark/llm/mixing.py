"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources get weights in code-point order (null last) and share a budget of words. A source's target stops at
``most`` times its own words; the excess is shared again by weight (a water level, solved on the table of
sources). Inside a source a document's expected copies are in proportion to its weight: the bit length of its size, so that
longer texts are likelier, or a weight column, taken to a 64th of a power of two. They stop at ``most``; what such documents leave is
shared again among the others of the source (a second water level, solved on the table of sources and weights, which is bounded). The
whole part is certain; for the rest each document draws a uniform number from a digest of its id and ranks by random odds over
inclusion odds, (u / (1 - u)) / (p / (1 - p)). The best ranks are taken, as many as bring the source's words nearest to its target.

No source is sorted as a whole: ranks fall into BINS equal bins, whose words are summed, the bin in which a source's target
falls into BINS finer ones, and only the finer one in which it falls is ordered by rows. So a hot source needs no more of one task than
about its BINS * BINS-th part (or the largest run of equal draws, that is repeated ids).

Defined cases: null text has size 0 and takes 0 words; size 0 is drawn like others; repeated rows are drawn
alike and each decided for itself; ids may be null (drawn as the text 'null'); a null source is a source; null, negative, zero, infinite and NaN weights
are never taken; a corpus without words has targets of 0; extra columns stay in ``apply_mix``, whatever their names; empty tables give
empty tables. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, hint_if_small, n_words, packed

WEIGHTS, SHARE_PERCENT, MOST, BINS, SEED = (3, 1, 2), 150, 2, 1024, "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows of (source, source_size), one each."""
    order = [F.col("source").isNull(), F.col("source")]
    numbered = sizes.withColumn("__k", F.row_number().over(Window.orderBy(*order)) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("__k") % len(weights) + 1).cast("int"))
    rows = numbered.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    # sources in order of the level at which they are full; the level is where the open ones share what the full ones leave
    up = Window.orderBy(F.col("cap") / F.col("w"), "__k")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_open", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share_percent)
    rows = rows.withColumn("level", (F.col("total") / 100 - F.col("full_before")) / F.col("w_open"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("__k"), F.col("level").alias("level"))))
    return rows.withColumn("__level", level.over(whole)["level"]).select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("__level") * F.col("w")), F.col("cap").cast("double")).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number between 0 and 1, both left out, from 48 bits of a digest."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def weight_class(weight: Column | None, size: Column) -> tuple[Column, Column]:
    """A document's class (null: never taken) and the weight of a class."""
    if weight is None:
        return F.length(F.bin(F.greatest(size, F.lit(1)))).cast("long"), F.col("class").cast("double")
    w = weight.cast("double")
    # NaN is above all numbers to the engine
    return F.when((w > 0) & (w < float("inf")), F.round(F.log2(w) * 64)).cast("long"), F.pow(F.lit(2.0), F.col("class") / 64)


def expected_copies(classes: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """source, class, m from rows of (source, class, words, w) and the sources' targets: m is in proportion to w and at most ``most``, and brings the source's words to its target where that can be."""
    rows = classes.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.*", "g.target")
    up = Window.partitionBy("source").orderBy(F.desc("w"))  # the heaviest class is full first
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
    rows = rows.withColumn("open", F.sum(F.col("words") * F.col("w")).over(up.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.try_divide(F.col("target") - F.col("before"), F.col("open")))
    whole = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.max(F.when(F.col("level") * F.col("w") <= most, F.struct("w", "level"))).over(whole)["level"]
    m = F.when(F.col("target") > 0, F.coalesce(F.least(F.col("at") * F.col("w"), F.lit(float(most))), F.lit(float(most)))).otherwise(0.0)
    # a whole number but for rounding is one: else all documents of a class would be drawn for a chance of 1e-16, in one bin
    return rows.withColumn("at", level).select("source", "class", F.when(F.abs(m - F.floor(m + 0.5)) < 1e-9, F.floor(m + 0.5).cast("double")).otherwise(m).alias("m"))


def _cut_bins(bins: DataFrame, scratch: Scratch) -> DataFrame:
    """source, cut_bin, before (words in the bins below it) from (source, bin, words, rest): the bin in which the words still wanted run out; null if all are wanted."""
    by = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    over = bins.withColumn("after", F.sum("words").over(by)).groupBy("source").agg(F.min(F.when(F.col("after") > F.col("rest"), F.struct("bin", (F.col("after") - F.col("words")).alias("before")))).alias("cut"))
    return scratch.table(over.select(F.col("source").alias("__s"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before")), "cuts")


def _decided(spark: SparkSession, rows: DataFrame, keep: tuple[str, ...], source: Column, text: Column, weights: tuple[int, ...], share_percent: int, most: int, weight: Column | None, seed: str) -> DataFrame:
    """The columns kept of rows, doc_id among them, with source, size, source_size, target, copies."""
    scratch = Scratch(spark, "mixing")
    base = rows.select(*keep, source.alias("source"), n_words(text).alias("size"), *([] if weight is None else [weight.alias("weight")]))
    of_class, of_weight = weight_class(None if weight is None else F.col("weight"), F.col("size"))
    base = scratch.table(base.withColumns({"class": of_class, "u": draw(F.col("doc_id"), seed)}), "sizes")
    classes = base.groupBy("source", "class").agg(F.sum("size").alias("words")).withColumn("w", of_weight)
    classes = scratch.table(classes, "classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = scratch.table(targets(sizes, weights, share_percent, most), "targets")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    shares = scratch.table(expected_copies(classes.where("class IS NOT NULL"), goal, most).withColumnsRenamed({"source": "__s", "class": "__c"}), "shares")
    rows = base.join(hint_if_small(goal.withColumnRenamed("source", "__g")), same("source", "__g")).join(hint_if_small(shares), same("source", "__s") & (F.col("class") == F.col("__c")), "left").drop("__g", "__s", "__c", "class")
    rows = rows.withColumn("m", F.coalesce("m", F.lit(0.0))).withColumn("sure", F.floor("m").cast("long")).withColumn("p", F.col("m") - F.col("sure"))
    odds = F.col("u") / (1 - F.col("u"))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, odds * ((1 - F.col("p")) / F.col("p"))))
    # null where nothing is drawn: least() alone would skip the null and put such rows into the last bin
    rows = rows.withColumn("fine", F.when(F.col("q").isNotNull(), F.least(F.floor(F.col("q") / (1 + F.col("q")) * (BINS * BINS)), F.lit(BINS * BINS - 1))).cast("long")).withColumn("bin", F.floor(F.col("fine") / BINS).cast("long"))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("sure")).alias("sure_words"), F.max("target").alias("target"))
    bins = bins.withColumn("rest", F.col("target") - F.sum("sure_words").over(Window.partitionBy("source"))).where("bin IS NOT NULL")
    bins = scratch.table(bins, "bins")
    rest = scratch.table(bins.groupBy(F.col("source").alias("__r")).agg(F.max("rest").alias("rest")), "rest")
    rows = rows.join(hint_if_small(rest), same("source", "__r"), "left").drop("__r")
    for column, part in (("bin", bins), ("fine", None)):
        if part is None:  # what lies in the cut bins, by finer bins; the words below those are wanted
            inner = rows.where("extra IS NULL")
            part = inner.groupBy("source", F.col("fine").alias("bin")).agg(F.sum("size").alias("words"), F.max(F.col("rest") - F.col("below")).alias("rest"))
        cuts = _cut_bins(part, scratch)
        below = F.coalesce(F.col("below"), F.lit(0)) if column == "fine" else F.lit(0)
        state = F.when(F.col(column).isNull(), 0).when(F.col("cut_bin").isNull() | (F.col(column) < F.col("cut_bin")), 1).when(F.col(column) > F.col("cut_bin"), 0)
        rows = rows.join(hint_if_small(cuts), same("source", "__s"), "left").drop("__s")
        rows = rows.withColumns({"extra": state if column == "bin" else F.coalesce("extra", state), "below": below + F.coalesce("before", F.lit(0))}).drop("cut_bin", "before")
    ranked = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("extra IS NULL").withColumn("upto", F.col("below") + F.sum("size").over(ranked))
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))
    edge = edge.withColumn("extra", F.when((F.col("upto") <= F.col("rest")) | nearer, 1).otherwise(0)).drop("upto")
    return rows.where("extra IS NOT NULL").unionByName(edge).withColumn("copies", F.col("sure") + F.col("extra"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, weight_col: str | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row, once per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), packed(docs))
    at = F.col("row")
    out = _decided(spark, rows, ("doc_id",), at[source_col], at[text_col], weights, share_percent, most, None if weight_col is None else at[weight_col], seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, weight_col: str | None = None, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; every row is decided for itself, as in ``mix``, and travels with its decision."""
    rows = docs.select(F.col(id_col).alias("doc_id"), packed(docs))
    at = F.col("row")
    out = _decided(spark, rows, ("doc_id", "row"), at[source_col], at[text_col], weights, share_percent, most, None if weight_col is None else at[weight_col], seed)
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
