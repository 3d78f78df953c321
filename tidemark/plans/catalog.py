"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import contact_queries, identity_queries, incident_queries, intake_queries, mart_queries, ops_queries, review_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**mart_queries.QUERIES, **contact_queries.QUERIES, **identity_queries.QUERIES, **intake_queries.QUERIES, **ops_queries.QUERIES, **incident_queries.QUERIES, **review_queries.QUERIES}
ORACLES: dict[str, str] = {**mart_queries.ORACLES, **contact_queries.ORACLES, **identity_queries.ORACLES, **intake_queries.ORACLES, **ops_queries.ORACLES, **incident_queries.ORACLES, **review_queries.ORACLES}
