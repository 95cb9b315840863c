"""All registered queries."""

from trailmark.plans import events_catalog, files_catalog, items_catalog, models_catalog  # noqa: F401
from trailmark.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
