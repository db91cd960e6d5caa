"""Registered queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import align_queries, corpus_queries, source_queries

MODULES = (corpus_queries, source_queries, align_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
