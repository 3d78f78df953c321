"""The strict CSV reader for files of any size: one file is many tasks.

Spark's text source splits a file into blocks and gives each block's physical lines in order. Whether a line begins inside quotes is told by the number of
quotes before it, so a block's effect is a small map: for either state at its begin, the state at its end and where its last record
begins. These maps are combined over a file's earlier blocks (a row a block), which settles every line's state at once. A line that begins and ends
outside quotes is a record by itself and stays where it is; only the lines of records that span several meet in a group, one record each. Records are then
parsed by the same rules as whole documents, and numbered by ranges.

Defined cases: those of ``csv_files.parse_strict`` and ``checked``, with the same rows and errors; a file whose last quote is never closed is an error without a place, whatever else is wrong with it, before any of
its lines are gathered; the place of bytes that are no UTF-8 isn't told; an empty file has no header (it gives no lines, and so an error row only where its path is listed).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranks import ranked
from tidemark.plans.lineage import cut
from tidemark.sources.csv_files import CsvError, parse_strict

#: Blocks of that many files at most are broadcast (a row a block).
BLOCKS = 100_000
_AT = re.compile(r"(.*) in row (\d+), column (\d+)")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, int, tuple[int, int], bool]]:
    """(path, block, line, value, quotes before it in the block modulo 2, where the record of the line begins if the block begins outside or inside quotes, whether the line before was of another block)."""
    last, line, odd, starts = None, 0, 0, [-1, -1]
    for b in batches:
        for path, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            new = (path, block) != last
            if new:
                last, line, odd, starts = (path, block), 0, 0, [-1, -1]
            starts[odd] = line  # outside quotes in the one case, inside in the other
            yield path, block, line, value, odd, (starts[0], starts[1]), new
            odd ^= value.count(b'"') & 1
            line += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def blocks(lines: DataFrame) -> DataFrame:
    """(path, block, inside, record_block, record_line, odd): each block's state at its begin, the record that is open there, and whether the file's quotes don't pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for path, block, _, value, odd, (out, ins), new in _walk(batches):
            row = (path, block, odd ^ (value.count(b'"') & 1), out, ins)
            if new:
                held.append(row)
            else:
                held[-1] = row
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True) if held else [()] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "block", "odd", "out", "ins"])

    per = lines.mapInArrow(run, "path string, block long, odd int, out long, ins long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumns({"inside": F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2, "odd_file": F.sum("odd").over(Window.partitionBy("path")) % 2 == 1})
    begins = F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("ins"))
    rows = rows.withColumn("open", F.when(begins >= 0, F.struct(F.col("block").alias("b"), begins.alias("l"))))
    return rows.select("path", "block", "inside", F.last("open", ignorenulls=True).over(before).alias("open"), F.col("odd_file").alias("odd"))


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, block, line, text) of every record, by where it begins, and the paths whose quotes don't pair."""
    lines = _lines(spark, path)
    maps = cut(blocks(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.binary()), ("before", pa.int32()), ("after", pa.int32()), ("out", pa.int64()), ("ins", pa.int64())]
        held: list[tuple] = []
        size = 0

        def put() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
            held.clear()
            return b

        for p, block, line, value, odd, (out, ins), _ in _walk(batches):
            held.append((p, block, line, value, odd, odd ^ (value.count(b'"') & 1), out, ins))
            size += len(value) + 100
            if size > 8 << 20:
                size = 0
                yield put()
        if held:
            yield put()

    rows = lines.mapInArrow(run, "path string, block long, line long, value binary, before int, after int, out long, ins long")
    small = maps.withColumnsRenamed({"path": "__p", "block": "__b"})
    small = F.broadcast(small) if maps.limit(BLOCKS + 1).count() <= BLOCKS else small
    rows = rows.join(small, (F.col("path") == F.col("__p")) & (F.col("block") == F.col("__b"))).where("NOT odd")
    begins = F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("ins"))
    alone = ((F.col("before") + F.col("inside")) % 2 == 0) & ((F.col("after") + F.col("inside")) % 2 == 0)
    rows = rows.withColumns({"alone": alone, "rb": F.when(begins >= 0, F.col("block")).otherwise(F.col("open.b")), "rl": F.when(begins >= 0, begins).otherwise(F.col("open.l"))})
    whole = rows.where("alone").select("path", "block", "line", F.col("value").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0))["value"], lambda text, x: F.concat(text, F.lit(b"\n"), x["value"]))
    wide = rows.where("NOT alone").groupBy("path", F.col("rb"), F.col("rl")).agg(parts.alias("parts")).select("path", F.col("rb").alias("block"), F.col("rl").alias("line"), joined.alias("text"))
    return whole.unionByName(wide), maps.where("odd").select("path").distinct()


def parsed(found: DataFrame) -> DataFrame:
    """(path, block, line, sub, cells, rows, why, row, col) of the rows of every record; a fault has no cells, and where in the record it is."""
    kinds = [("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("sub", pa.int32()), ("cells", pa.list_(pa.string())), ("rows", pa.int64()), ("why", pa.string()), ("row", pa.int64()), ("col", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, block, line, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = block == line == 0
                try:
                    # the parser drops one mark, which only a document's first row may lose
                    rows = parse_strict(("" if first else "﻿") + text.decode("utf-8")) or [[""]]
                    out += [(path, block, line, k, r, len(rows) if not k else 0, None, None, None) for k, r in enumerate(rows)]
                except CsvError as e:
                    m = _AT.fullmatch(str(e))
                    out.append((path, block, line, 0, None, 1, m[1], int(m[2]), int(m[3])))
                except UnicodeDecodeError as e:
                    out.append((path, block, line, 0, None, 1, e.reason, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    return found.select("path", "block", "line", "text").mapInArrow(run, "path string, block long, line long, sub int, cells array<string>, rows long, why string, row long, col long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_id, headers, cells, error) of all rows of the CSV files of a path, as ``csv_files.read_documents`` gives them, for files of any size."""
    found, odd = records(spark, path)
    at = F.struct("block", "line", "sub")
    rows = cut(parsed(found))
    blank = ~F.exists("cells", lambda c: F.trim(c) != "")
    names = F.transform("headers", lambda h: F.lower(F.trim(h)))
    heads = rows.where("why IS NULL").groupBy("path").agg(F.min_by("cells", at).alias("headers"), F.min(at).alias("top"))
    heads = heads.withColumn("twice", F.size(F.array_distinct(names)) < F.size("headers"))
    faults = rows.where("why IS NOT NULL").groupBy("path").agg(F.min(F.struct(at.alias("at"), "why", "row", "col")).alias("f"))
    told = rows.join(faults, "path").where(at < F.col("f.at")).groupBy("path").agg(F.sum("rows").alias("n"))
    torn = faults.join(told, "path", "left").select("path", F.concat(F.col("f.why"), F.when(F.col("f.row").isNotNull(), F.format_string(" in row %d, column %d", F.coalesce("n", F.lit(0)) + F.col("f.row"), F.col("f.col"))).otherwise("")).alias("error"))
    body = rows.where("why IS NULL").join(heads, "path").where(at > F.col("top"))
    ragged = body.where(~blank & (F.size("cells") != F.size("headers"))).groupBy("path").agg(F.min(F.struct(at.alias("at"), F.size("cells").alias("k"), F.size("headers").alias("m"))).alias("f"))
    place = rows.join(ragged, "path").where(at < F.col("f.at")).groupBy("path", "f").agg((F.sum("rows") - F.max(F.when((F.col("block") == F.col("f.at.block")) & (F.col("line") == F.col("f.at.line")), F.col("rows") - F.col("f.at.sub")).otherwise(0)) + 1).alias("n"))
    ragged = place.select("path", F.format_string("%d cells instead of %d in row %d", F.col("f.k"), F.col("f.m"), F.col("n")).alias("error"))
    repeated = heads.where("twice").select("path", F.lit("a header is repeated").alias("error"))
    never = odd.select("path", F.lit("a quote that is never closed").alias("error"))
    errors = torn.withColumn("n", F.lit(0)).union(repeated.withColumn("n", F.lit(1))).union(ragged.withColumn("n", F.lit(2))).union(never.withColumn("n", F.lit(0)))
    errors = errors.groupBy("path").agg(F.min(F.struct("n", "error")).alias("e")).select("path", F.col("e.error").alias("error"))
    good = body.where(~blank).join(errors.select("path"), "path", "left_anti").select("path", "block", "line", "sub", "headers", "cells")
    numbered = ranked(good, ["path"], [F.asc("block"), F.asc("line"), F.asc("sub")], "row_id").select("path", F.col("row_id").cast("long").alias("row_id"), "headers", "cells", F.lit(None).cast("string").alias("error"))
    none = lambda t: F.lit(None).cast(t)
    return numbered.unionByName(errors.select("path", none("long").alias("row_id"), none("array<string>").alias("headers"), none("array<string>").alias("cells"), "error"))
