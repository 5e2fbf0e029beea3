"""All registered queries; importing the modules fills the registry."""

from tablewright.plans import boosting, history, models, tables, texts, vectors, wide  # noqa: F401
from tablewright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
