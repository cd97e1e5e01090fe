"""All named queries."""

from funnelspark.plans import check_queries, diagnosis_queries, mart_queries, metric_queries  # noqa: F401
from funnelspark.plans.common import REGISTRY

__all__ = ["REGISTRY"]
