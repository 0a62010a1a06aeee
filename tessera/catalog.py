"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from .plans import cdc_queries, datalog_queries, file_queries, graph_queries, migration_queries, ops_queries, profile_queries, report_queries, rollup_queries, transform_queries, verify_queries, write_queries  # noqa: F401
from .plans.base import QUERIES, SQL  # noqa: F401
