"""Connected components by alternating large and small stars, in DataFrame functions only.

Rounds grow with the logarithm of the longest path. Each round's edges are written to the shared folder, so
lineage stays short; nothing is collected but a count and a checksum. Smallest neighbours are found by
map-side aggregation and joined back, so a node with a third of all edges is split like any skewed join side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every node of the edges (a, b): label is the smallest id of its component. Loops, repeated and null edges are ignored."""
    at = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = scratch.table(at, "edges")
    seen = None
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # all v are below u
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.table(small, "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(at)
        at = new
        if state == seen:
            break
        seen = state
    return at.select(F.col("u").alias("id"), F.col("v").alias("label")).union(at.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
