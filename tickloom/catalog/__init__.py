"""Runnable queries over the given tables, one module per operator family."""

from tickloom.catalog import check_queries, fill_queries, queue_queries, report_queries, rule_queries, stream_queries, time_queries  # noqa: F401
from tickloom.catalog.base import ORACLES, QUERIES  # noqa: F401
