"""All queries of the core."""

from plinth.plans import answers, audits, datasets, graphs, pages, star, streams, texts  # noqa: F401
from plinth.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
