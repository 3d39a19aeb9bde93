"""Registered queries: every operator on the given tables, with the equivalent SQL where SQL can say it."""

from pairlens.catalog.registry import REGISTRY, oracle_sql, queries

__all__ = ["REGISTRY", "oracle_sql", "queries"]
