"""All registered queries."""

from weftline.plans import suite_builds, suite_calendar, suite_keys, suite_pages, suite_snapshots, suite_tables, suite_text  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
