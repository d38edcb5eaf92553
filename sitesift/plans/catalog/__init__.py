"""All registered queries."""

from sitesift.plans.catalog import (  # noqa: F401
    group_queries, html_queries, metric_queries, model_queries, record_queries, report_queries, stream_queries,
    url_queries, vector_queries,
)
from sitesift.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
