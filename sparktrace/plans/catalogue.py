"""All registered queries over the given tables, with their SQL twins."""

from sparktrace.plans import report_plans, reshape_plans, series_plans, stats_plans  # noqa: F401
from sparktrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
