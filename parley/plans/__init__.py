"""Registered queries."""

from . import conversations, corpus, evaluation, events, exchange  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
