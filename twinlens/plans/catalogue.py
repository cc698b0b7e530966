"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from twinlens.plans import queries_columns, queries_compare, queries_intake, queries_report
from twinlens.plans.registry import QUERIES, tables

__all__ = ["QUERIES", "queries_columns", "queries_compare", "queries_intake", "queries_report", "tables"]
