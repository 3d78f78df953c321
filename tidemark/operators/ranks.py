"""Row numbers inside groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.lineage import cut


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their number (from 1) in their group by an order, cut.

    Rows are dealt to ranges of group and order and sorted there, so a group of any size lies in many tasks. A row's number is its place in its range's
    part of the group, and the counts of the group's earlier parts (a row for each range and group that meet). Ties of the order fall as the ranges hold them."""
    keys = [*(F.asc_nulls_first(c) for c in by), *order]
    at = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.asc("__tie")).sortWithinPartitions(*keys, F.asc("__tie")).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    at = cut(at.withColumn("__range", F.shiftright("__at", 33)))
    parts = at.groupBy(*by, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__r"), "__first", earlier.alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    met = F.col("__range") == F.col("__r")
    for x in same:
        met = met & x
    return at.join(parts, met).withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).select(*rows.columns, name)
