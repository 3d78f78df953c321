"""Queries and SQL of this subpackage, with the pipeline."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import oracles, queries

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES = oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
