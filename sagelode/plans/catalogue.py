"""All queries of the engine by name, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import stream_queries
from . import analytics_queries, assembly_queries, chunk_queries, index_queries, report_queries, retrieval_queries, routing_queries, statute_queries, text_queries

_MODULES = (text_queries, retrieval_queries, analytics_queries, assembly_queries, report_queries, routing_queries, chunk_queries, statute_queries, index_queries, stream_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25, TF-IDF and dense lists fused, weighted and cut to ten a query."""
    return retrieval_queries.hybrid_search(spark, sf_dir)
