"""All named queries of the reference's operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans import catalog_queries, compiler_queries, document_queries, evidence_queries, fixture_queries, lineage_queries, source_queries, table_queries, workflow_queries

_PARTS = (catalog_queries, lineage_queries, document_queries, fixture_queries, evidence_queries, workflow_queries, source_queries, compiler_queries, table_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
