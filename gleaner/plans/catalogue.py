"""All registered queries."""

from gleaner.plans import cleaning, models, stages, texts, truth  # noqa: F401
from gleaner.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
