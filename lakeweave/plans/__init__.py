"""Queries and pipelines made of the operators."""

from lakeweave.plans import lake_queries, model_queries, operator_queries, profile_queries, table_queries, vector_queries  # noqa: F401
from lakeweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
