"""Registered queries over the event series, and their SQL."""

from . import events, models, reports
from .events import flagship

QUERIES = events.QUERIES | models.QUERIES | reports.QUERIES
SQL = events.SQL | models.SQL | reports.SQL

__all__ = ["QUERIES", "SQL", "flagship"]
