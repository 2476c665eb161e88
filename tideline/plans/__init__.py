"""Queries over the test tables, each with the SQL that states its result."""

from tideline.plans.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
