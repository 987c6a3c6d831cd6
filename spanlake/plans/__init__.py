"""Registered queries."""

from . import queries_charts, queries_ledger, queries_lists, queries_stats, queries_summary  # noqa: F401
from .registry import ORACLES, QUERIES, run  # noqa: F401
