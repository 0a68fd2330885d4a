"""Queries of the training-data operators."""

from plinth.llm import containers, crossing, leaks, mixture, ocr, pairs, quality, quotas, sets, splits  # noqa: F401
from plinth.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
