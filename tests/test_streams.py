"""Streams over files, part by part, against their batch forms."""

import datetime as dt

from tidemark.operators import incidents
from tidemark.streaming import incidents as live


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def parts(spark, rows, schema, path, n):
    """A stream of n files, one a batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_expectation_timers(spark, tmp_path):
    rows = [("a", at(0), "sql", ""), ("b", at(0), "sql", ""), ("c", at(1), "lead", ""), ("a", at(10), "sql", " "), ("b", at(20), "sql", "owner"), ("d", at(50), "sql", ""), ("z", at(200), "lead", "x"), ("z", at(201), "lead", "x")]
    schema = "record_id string, at timestamp, condition string, required string"
    got = live.run_to_end(live.expectations(parts(spark, rows, schema, str(tmp_path / "s"), 4), ("sql",), 60), "timers").collect()
    batch = incidents.expectations_due(spark.createDataFrame(rows, schema), ("sql",), 60, "2024-01-01 03:00:00").collect()
    assert {(r.record_id, r.since) for r in got} == {(r.record_id, r.since) for r in batch} == {("a", at(0)), ("d", at(50))}
