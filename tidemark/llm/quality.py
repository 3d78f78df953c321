"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame functions only.

Each text gets counts (words, their code points, symbols, repeated lines, words in repeated 8-word windows,
words said twice in a row)
and, from them, five integer features. Per language and source a sketch of each feature is kept: a
log-linear histogram (exact below 32, then 16 buckets per power of two, so 6 % relative error) whose counts
merge by addition, map-side first, and so in any order with the same result. Sketches of fewer than
MIN_GROUP texts are merged into their language's, and those into the whole corpus's. Quantiles of the
sketches give each group's thresholds, which are joined back to filter.

Thresholds follow each group's quantiles; none is a constant. Word length is fenced on both sides, REACH times the distance of the
quartile from the median (or the sketch's resolution there) away. The other features are mostly zero in good text and far from it in junk, so their fence stands in the first
jump of the upper quantiles (GRID): where, on the scale of the feature's unit, one quantile is JUMP times the one before, at their geometric
mean. Where they don't jump and the feature is zero in three quarters of a group's texts, the fence is fitted to the texts that have it, pooled
by language (by the whole corpus below MIN_GROUP of them, and none below that): SPAN times the distance of their 90th percentile from their median beyond the former.
A group whose upper quantiles rise evenly from above zero has no such fence, and one that is junk in a quarter of its texts or more is
taken as it is. Feature values of texts that fail the base rules are not learned from.

Equal 8-word windows are found by 64-bit hashes of their words.

Defined cases: null text has no words, and so fails; null language or source is a group of its own; empty
texts fail; repeated rows are judged alike, each counted; rows are never dropped by ``judge``; extra columns
stay in ``filter_docs`` and are left out by ``judge``; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch, hint_if_small, words

WINDOW, MIN_WORDS, MAX_REPEAT, MIN_GROUP = 8, 20, 30, 100
SYMBOLS = "#*$%&|<>"
#: The features whose jumps are looked for, with the unit at which a difference begins to count: per 1000 words or lines.
JUMPING = {"symbols": 100, "dup_lines": 500, "repeats": 300, "echoes": 50}
#: Percentiles of a sketch between which a jump is looked for, and how many times larger the next one must be.
GRID, JUMP = (75, 80, 85, 90, 95, 98, 99, 100), 3
#: The fences of word length stand so many times the distance of the quartile from the median away from it, or the sketch's resolution if that is more.
REACH = 5
PERCENTILES = (25, 50, *GRID)
#: Where a feature is mostly zero, its fence stands so many times the distance from the median to the 90th percentile of the other texts beyond the latter.
SPAN = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with COUNTS, n_lines (lines with a word) and n_echoes (words equal to the one before)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__w", words(text)).withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("__hw", F.transform("__w", lambda w: F.xxhash64(w)))
    last = F.col("n_words").cast("int") - WINDOW
    at = lambda i: F.xxhash64(*(F.get("__hw", i + k) for k in range(WINDOW)))
    out = out.withColumn("__h", F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<long>")))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("__s", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    again = F.filter("__s", lambda e, k: (e["h"] == F.get("__s", k - 1)["h"]) | (e["h"] == F.get("__s", k + 1)["h"]))
    spots = F.sort_array(F.transform(again, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate(spots, zero, lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["total"] + i + WINDOW - F.greatest(i, acc["end"])).alias("total")))["total"]
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter("__hw", lambda h, i: h == F.get("__hw", i - 1))).cast("long").alias("n_echoes"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def features() -> dict[str, Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    whole = lambda a, b: F.floor(a / b).cast("long")
    return {"symbols": whole(1000 * F.col("n_symbols"), n), "dup_lines": whole(1000 * F.col("n_dup_lines"), lines), "repeats": whole(1000 * F.col("n_repeat_words"), n), "echoes": whole(1000 * F.col("n_echoes"), n), "word_length": whole(100 * F.col("word_chars"), n)}


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number from 0: the number below 32; then the power of two and the four next bits."""
    shift = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(shift * 16 + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long")).cast("long")


def bucket_low(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.floor(b / 16) - 1
    return F.when(b < 32, b).otherwise((b - shift * 16) * F.pow(F.lit(2.0), shift).cast("long")).cast("long")


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Sketch counts (lang, source, feature, bucket, n) of the texts that pass the base rules."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), bucket(v).alias("bucket")) for k, v in features().items()))).alias("__f")
    return counted.where(~base_failed()).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), rows).groupBy("lang", "source", "__f.feature", "__f.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """level, lang, source, feature, n and the PERCENTILES of a sketch, at all levels in one pass: own (language and source), lang, whole; some_lang and some_whole are of the texts that have the feature at all."""
    none = {c: F.lit(None).cast(sketch.schema[c].dataType) for c in ("lang", "source")}
    at = lambda level, *own: F.struct(F.lit(level).alias("level"), *((F.col(c) if c in own else v).alias(c) for c, v in none.items()))
    every, some = F.array(at("own", "lang", "source"), at("lang", "lang"), at("whole")), F.array(at("some_lang", "lang"), at("some_whole"))
    rows = sketch.select(F.explode(F.when(F.col("bucket") > 0, F.concat(every, some)).otherwise(every)).alias("__at"), "feature", "bucket", "n").select("__at.*", "feature", "bucket", "n")
    keys = ("level", "lang", "source", "feature")
    by = Window.partitionBy(*keys)
    cum = rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by)).withColumn("low", bucket_low(F.col("bucket")))
    q = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("low"))).alias(f"q{p}")
    return cum.groupBy(*keys).agg(F.max("all").alias("n"), *map(q, PERCENTILES))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, then `<feature>_low` and `<feature>_high` (null: no fence) of each group of a sketch.

    With a scratch, the sketch and its quantiles are written first: the quantiles are read five times, and a plan that holds what makes them
    five times over is half a megabyte of text, which the driver makes again at each of the query's stages.
    """
    if scratch:
        sketch = scratch.table(sketch, "sketches")
    made = quantiles(sketch)
    if scratch:
        made = scratch.table(made, "quantiles")
    names = ["n", *(f"q{p}" for p in PERCENTILES)]
    part = lambda level, tag, columns, *keys: made.where(F.col("level") == level).select(*keys, *(F.col(c).alias(f"{tag}_{c}") for c in columns))
    own = made.where("level = 'own'").drop("level")
    own = own.alias("o").join(part("lang", "l", names, "lang", "feature").alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.feature") == F.col("l.feature"))).select("o.*", *(f"l_{c}" for c in names))
    own = own.join(part("whole", "w", names, "feature"), "feature")
    parts = ("n", "q50", "q90")
    some_lang = part("some_lang", "zl", parts, F.col("lang").alias("z_lang"), F.col("feature").alias("z_feature"))
    own = own.join(some_lang, F.col("lang").eqNullSafe(F.col("z_lang")) & (F.col("feature") == F.col("z_feature")), "left").join(part("some_whole", "zw", parts, "feature"), "feature", "left")
    pooled = lambda c: F.when(F.col("zl_n") >= min_group, F.col(f"zl_{c}")).when(F.col("zw_n") >= min_group, F.col(f"zw_{c}"))
    level = lambda c: F.when(F.col("n") >= min_group, F.col(c)).when(F.col("l_n") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    unit = F.coalesce(*(F.when(F.col("feature") == k, F.lit(u)) for k, u in JUMPING.items()))
    own = own.select("lang", "source", "feature", unit.alias("unit"), *(level(c).alias(c) for c in names[1:]), pooled("q50").alias("z50"), pooled("q90").alias("z90"))
    lifted = {p: F.col(f"q{p}") + F.col("unit") for p in GRID}
    jump = F.coalesce(*(F.when(lifted[b] >= JUMP * lifted[a], F.floor(F.sqrt((lifted[a] * lifted[b]).cast("double"))) - F.col("unit")) for a, b in zip(GRID, GRID[1:])))
    jump = F.coalesce(jump, F.when(F.col("q75") == 0, F.col("z90") + SPAN * (F.col("z90") - F.col("z50"))))
    at = lambda k, x: F.max(F.when(F.col("feature") == k, F.col(x)))
    length = (F.col("q50") - REACH * F.greatest(F.col("q50") - F.col("q25"), F.floor(F.col("q50") / 16)), F.col("q50") + REACH * F.greatest(F.col("q75") - F.col("q50"), F.floor(F.col("q50") / 16)))
    own = own.select("lang", "source", "feature", jump.alias("jump"), length[0].alias("low"), length[1].alias("high"))
    fences = [at(k, "jump").alias(f"{k}_high") for k in JUMPING] + [at("word_length", side).alias(f"word_length_{side}") for side in ("low", "high")]
    return own.groupBy("lang", "source").agg(*fences)


def verdict() -> Column:
    """Whether no feature lies beyond a fence; true where a group has no fences."""
    f = features()
    within = [f[k] <= F.col(f"{k}_high") for k in f] + [f["word_length"] >= F.col("word_length_low")]
    return reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(True)) for x in within))


def _fenced(counted: DataFrame, limits: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    limits = hint_if_small(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    joined = counted.join(limits, F.col(lang_col).eqNullSafe(F.col("__lang")) & F.col(source_col).eqNullSafe(F.col("__source")), "left")
    # one number over both sides of the join: as two conditions, the first would be pushed below the counts and inline them many times over
    faults = base_failed().cast("int") + (~verdict()).cast("int")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", faults == 0)


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every row. The counts are made once and kept as a table in the shared folder."""
    scratch = Scratch(spark, "quality")
    counted = with_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).drop("text")
    counted = scratch.table(counted, "counts")
    limits = scratch.table(thresholds(sketches(counted), min_group, scratch), "thresholds")
    return _fenced(counted, limits, "lang", "source").select("doc_id", *COUNTS, "base_failed", "kept")


def filter_docs(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of docs that are kept, with their columns. The texts are counted twice rather than shuffled or stored."""
    scratch = Scratch(spark, "quality")
    short = with_counts(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).drop("text")
    # written first: a filter over the counts would inline them
    limits = scratch.table(thresholds(sketches(scratch.table(short, "counts")), min_group, scratch), "thresholds")
    renamed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang_of"), F.col(source_col).alias("__source_of"))
    counted = with_counts(renamed, "__text").drop("__text")
    return _fenced(counted, limits, "__lang_of", "__source_of").where("kept").select("__row.*")
